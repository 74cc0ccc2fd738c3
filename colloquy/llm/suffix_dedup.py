"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every window of ``size`` bytes is bound to one suffix: the one that starts at the
window's least ``KEY``-byte hash.  Only those suffixes, about one in sixteen, are
sorted, and only through the window.

* First pass: the digit is the suffix's first ``KEY`` bytes, then the run of all windows
  bound to it.  Suffixes alone in their group are done.  A run that also stands in a
  smaller document is a set of repeated windows; nothing more is asked about it.
* Second pass: where the runs of a group differ, its windows are sorted on their own.
  Equal groups are exactly the repeated windows.

Digits are compared by hash: 128 bits for a run, 96 for a window.  Texts are stored once,
in chunks that are bucketed in the shared folder; the passes shuffle packed digits only.

A task holds one chunk: its texts where Arrow has them, 28 bytes a suffix and 12 bytes a
window asked about.  Windows are ordered a share of the buckets at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common
from colloquy.llm.common import small_batches, stored, table, tidy, tidy_cogroup, tidy_group
from colloquy.llm.windows import BUFFER, Rolling, mixed, window_samples
from colloquy.session import scratch_path

KEY = 20
CHUNK_BYTES = 8 << 20
GROUP_ENTRIES = 1_000_000
# Windows of a chunk that are put in order at once, about.
SHARE_WINDOWS = 500_000
# Rows whose cut texts are made at once.
CUT_ROWS = 1000
# A key with more than this share of all suffixes is dealt by run; there are at most as many such keys.
HOT_SHARE = 4000
CHUNK_HOT = 64
NO_ID = np.iinfo(np.int64).max

TEXT, HEAVY = 0, 1
STORE = "kind int, chunk long, entries long, data binary"
MESSAGE = "bucket long, chunk long, data binary"


def pack(ascending: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns as compressed byte planes; the first, which ascends, as differences."""
    wide = ascending.astype(np.uint64)
    columns = [np.diff(wide, prepend=np.uint64(0)), *(c.astype(np.uint64) for c in others)]
    planes = [c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.compress(b"".join([len(wide).to_bytes(8, "little"), *planes]), 1)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(columns, 8, n)
    first, *others = (np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes)
    return [np.cumsum(first, dtype=np.uint64), *others]


def to_ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def byte_views(texts: pa.ChunkedArray) -> list[memoryview]:
    """The bytes of each text where Arrow holds them; a null has none."""
    out = []
    for part in texts.cast(pa.large_binary()).chunks:
        if len(part):
            _, ends, data = part.buffers()
            ends = np.frombuffer(ends, np.int64)[part.offset:part.offset + len(part) + 1]
            stops = np.where(part.is_valid().to_numpy(zero_copy_only=False), ends[1:], ends[:-1])
            data = memoryview(data or b"").cast("B")
            out += [data[a:b] for a, b in zip(ends[:-1].tolist(), stops.tolist())]
    return out


class Suffixes:
    """The sampled suffixes of the documents of one chunk, each with its run of windows ``[low, high)``."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, size: int):
        self.size = size
        self.ids = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy()
        self.texts = byte_views(texts)
        parts: dict[str, list[np.ndarray]] = {name: [] for name in ("doc", "low", "high", "key", "run")}
        for doc, text in enumerate(self.texts):
            # A text longer than a buffer is sampled in stretches of window starts.
            for base in range(0, max(0, len(text) - size + 1), BUFFER):
                data = np.frombuffer(text[base:base + BUFFER + size - 1], np.uint8)
                hashes = Rolling(data, 1)
                keys = hashes.every(KEY)
                sample = window_samples(keys, size - KEY + 1)
                change = np.flatnonzero(np.diff(sample)) + 1
                low, high = np.concatenate(([0], change)), np.concatenate((change, [len(sample)]))
                # One text has less than 2^31 bytes, on the JVM and in a column of strings.
                parts["doc"].append(np.full(len(low), doc, np.int32))
                parts["low"].append((low + base).astype(np.int32))
                parts["high"].append((high + base).astype(np.int32))
                parts["key"].append(mixed(keys[sample[low]]))
                parts["run"].append(hashes.spans(low, high + size - 1))

        def join(name: str, kind: type) -> np.ndarray:
            found = parts.pop(name)
            return np.concatenate(found) if found else np.zeros(0, kind)

        self.doc, self.low, self.high = join("doc", np.int32), join("low", np.int32), join("high", np.int32)
        self.key, self.run = join("key", np.uint64), join("run", np.uint64)

    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different (key, run) with the chunk's smallest id of each; and the place of every suffix among them."""
        order = sorted_pairs(self.key, self.run)
        key, run = self.key[order], self.run[order]
        fresh = group_starts(key, run)
        starts = np.flatnonzero(fresh)
        owner = np.minimum.reduceat(self.ids[self.doc[order]], starts) if len(starts) else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        return key[starts], run[starts], owner, place, order

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window bound to the chosen suffixes, in their order."""
        chosen = np.flatnonzero(chosen)
        n = int((self.high[chosen] - self.low[chosen]).sum(dtype=np.int64))
        first, second, done = np.empty(n, np.uint64), np.empty(n, np.uint32), 0
        for at in np.split(chosen, np.flatnonzero(np.diff(self.doc[chosen])) + 1) if len(chosen) else ():
            text = self.texts[self.doc[at[0]]]
            low, high = self.low[at].astype(np.int64), self.high[at].astype(np.int64)
            begin = np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low)
            begin += np.arange(len(begin))
            bases = range(0, len(text) - self.size + 1, BUFFER)
            cuts = np.searchsorted(begin, [*bases, len(text)])
            for base, here in zip(bases, map(lambda a, b: begin[a:b], cuts, cuts[1:])):
                if not len(here):
                    continue
                data = np.frombuffer(text[base:base + BUFFER + self.size - 1], np.uint8)
                to = slice(done, done := done + len(here))
                first[to] = Rolling(data, 11).spans(here - base, here - base + self.size)
                second[to] = Rolling(data, 13).spans(here - base, here - base + self.size) >> np.uint64(32)
        return first, second


def sorted_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order by two columns; only rows that tie in the first are sorted by the second."""
    order = np.argsort(first)
    same = ~group_starts(first[order])
    tied = same.copy()
    tied[:-1] |= same[1:]
    rows = order[tied]
    order[tied] = rows[np.lexsort((second[rows], first[rows]))]
    return order


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(sorted_columns[0]), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return fresh


def key_buckets(key: np.ndarray, run: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The group that orders a suffix: by its key, by its run where the key is hot."""
    at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
    is_hot = hot[at] == key if len(hot) else np.zeros(len(key), bool)
    return np.where(is_hot, buckets + (run % np.uint64(buckets)).astype(np.int64),
                    (key % np.uint64(buckets)).astype(np.int64))


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The stable order by bucket; numpy sorts 16-bit numbers by radix."""
    small = not len(bucket) or bucket.max() < 1 << 16
    return np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")


def _split(chunk: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One message for each bucket; the order inside is kept."""
    order = by_bucket(bucket)
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(bucket[at[0]]), chunk, pack(*(c[at] for c in columns))


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table(
        {"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.int64()),
         "data": pa.array([r[2] for r in rows], pa.binary())}
    )


def chunked(docs: DataFrame, id_column: str, text_column: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            rows = pa.Table.from_batches(held)
            found = Suffixes(rows.column(id_column), rows.column(text_column), size)
            key, _, _, _, _ = found.digits()
            fresh = np.flatnonzero(group_starts(key)) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.append(fresh, len(key)))
            heavy = many >= CHUNK_HOT
            kinds = [(TEXT, len(key), to_ipc(held)), (HEAVY, int(heavy.sum()), pack(key[fresh[heavy]], many[heavy]))]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in kinds], pa.int32()), pa.array([chunk] * len(kinds), pa.int64()),
                 pa.array([n for _, n, _ in kinds], pa.int64()), pa.array([d for _, _, d in kinds], pa.binary())],
                names=["kind", "chunk", "entries", "data"],
            )

        held, size_held = [], 0
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text_column)], np.int64)
            start = 0
            for row, n in enumerate(sizes.tolist()):
                size_held += n + 64
                if size_held >= CHUNK_BYTES:
                    yield flush([*held, batch.slice(start, row + 1 - start)])
                    held, size_held, start = [], 0, row + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield flush(held)

    return run


def first_requests(id_column: str, text_column: str, size: int, hot: np.ndarray, buckets: int) -> Callable:
    """The digits of each chunk, made from its text again: cheaper than to keep them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0), batch.column(1)):
                rows = from_ipc(data)
                key, run, owner, _, _ = Suffixes(rows.column(id_column), rows.column(text_column), size).digits()
                del rows
                messages = list(_split(chunk.as_py(), key_buckets(key, run, hot, buckets), key, run, owner))
                del key, run, owner
                yield from _messages(messages).to_batches()
                del messages
                common._give_back()

    return run


def first_pass(buckets: int) -> Callable:
    def run(messages: pa.Table) -> pa.Table:
        """Codes in the order of each message: 1 where a smaller document has the run, 2 where windows must be asked."""
        parts = [unpack(d, 3) for d in messages.column("data").to_pylist()]
        sizes = [len(p[0]) for p in parts]
        key, run, owner = (np.concatenate(c) for c in zip(*parts))
        owner = owner.astype(np.int64)
        order = sorted_pairs(key, run)
        k, r, o = key[order], run[order], owner[order]
        new_key, new_run = group_starts(k), group_starts(k, r)
        least = np.minimum.reduceat(o, np.flatnonzero(new_run))[np.cumsum(new_run) - 1]
        at = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - 1
        several = (np.add.reduceat(new_run.astype(np.int64), at) > 1) & (
            np.minimum.reduceat(o, at) < np.maximum.reduceat(o, at))
        hot = messages.column("bucket")[0].as_py() >= buckets
        codes = np.empty(len(order), np.uint8)
        codes[order] = np.where(o > least, 1, np.where(hot | several[group], 2, 0))
        cuts = np.cumsum(sizes)[:-1]
        return _messages([
            (b, c, zstandard.compress(part.tobytes(), 1))
            for b, c, part in zip(messages.column("bucket").to_pylist(), messages.column("chunk").to_pylist(),
                                  np.split(codes, cuts))
        ])

    return run


def _chunk(texts: pa.Table, id_column: str, text_column: str, size: int) -> tuple[pa.Table, Suffixes]:
    rows = from_ipc(texts.column("data")[0])
    return rows, Suffixes(rows.column(id_column), rows.column(text_column), size)


def _answers(answers: pa.Table, bucket: np.ndarray) -> np.ndarray:
    """Put the answers of all buckets back into the order of the entries."""
    order = by_bucket(bucket)
    parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist()))
    joined = np.concatenate([np.frombuffer(zstandard.decompress(d), np.uint8) for _, d in parts] or [np.zeros(0, np.uint8)])
    out = np.empty(len(bucket), np.uint8)
    out[order] = joined
    return out


def _decide(found: Suffixes, answers: pa.Table, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose windows are all repeated, and suffixes whose windows must be asked one by one."""
    key, run, owner, place, _ = found.digits()
    code = _answers(answers, key_buckets(key, run, hot, buckets))
    behind = found.ids[found.doc] > owner[place]
    return behind | (code[place] == 1), ~behind & (code[place] == 2)


def _windows(found: Suffixes, asked: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each share of the buckets: different windows of a chunk, their smallest ids and buckets; document, start and place of every asked window.

    Equal windows have equal buckets, so a share needs no other; every bucket is in one share.
    """
    first, second = found.windows(asked)
    asked = np.flatnonzero(asked)
    ends = np.cumsum(found.high[asked] - found.low[asked], dtype=np.int64)
    shares = min(buckets, -(-len(first) // SHARE_WINDOWS))
    share = np.empty(len(first), np.uint16)
    for at in range(0, len(first), SHARE_WINDOWS):
        # Below 2^16 shares, a chunk would have to hold over 3 * 10^10 windows for more.
        share[at:at + SHARE_WINDOWS] = window_buckets(first[at:at + SHARE_WINDOWS], buckets) * shares // buckets
    for n in range(shares):
        here = np.flatnonzero(share == n)
        order = sorted_pairs(first[here], second[here])
        at = here[order]
        a, b = first[at], second[at]
        fresh = group_starts(a, b)
        starts = np.flatnonzero(fresh)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        suffix = np.searchsorted(ends, here, side="right")
        doc, start = found.doc[asked[suffix]], found.high[asked[suffix]] - (ends[suffix] - here)
        owner = np.minimum.reduceat(found.ids[doc[order]], starts) if len(starts) else np.zeros(0, np.int64)
        a, b = a[starts], b[starts]
        yield a, b, owner, window_buckets(a, buckets), doc, start, place


def window_buckets(first: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(first) % np.uint64(buckets)).astype(np.int64)


def second_requests(id_column: str, text_column: str, size: int, hot: np.ndarray, buckets: int) -> Callable:
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _messages([])
        _, found = _chunk(texts, id_column, text_column, size)
        _, asked = _decide(found, answers, hot, buckets)
        chunk, messages = texts.column("chunk")[0].as_py(), []
        for first, second, owner, bucket, *_ in _windows(found, asked, buckets):
            messages += _split(chunk, bucket, first, second, owner)
        return _messages(messages)

    return run


def second_pass(messages: pa.Table) -> pa.Table:
    """1 for each window that stands in a smaller document."""
    parts = [unpack(d, 3) for d in messages.column("data").to_pylist()]
    sizes = [len(p[0]) for p in parts]
    first, second, owner = (np.concatenate(c) for c in zip(*parts))
    owner = owner.astype(np.int64)
    order = sorted_pairs(first, second)
    o, fresh = owner[order], group_starts(first[order], second[order])
    codes = np.empty(len(order), np.uint8)
    codes[order] = o > np.minimum.reduceat(o, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    return _messages([
        (-1 - b, c, zstandard.compress(part.tobytes(), 1))
        for b, c, part in zip(messages.column("bucket").to_pylist(), messages.column("chunk").to_pylist(),
                              np.split(codes, np.cumsum(sizes)[:-1]))
    ])


def cut_text(text: bytes | memoryview, covered: np.ndarray, size: int) -> tuple[bytes | memoryview, int, int]:
    """The bytes outside the covered windows, how many went, and in how many runs."""
    if not covered.any():
        return text, 0, 0
    change = np.zeros(len(text) + 1, np.int32)
    starts = np.flatnonzero(covered)
    change[starts] += 1
    change[starts + size] -= 1
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def removal(id_column: str, text_column: str, size: int, hot: np.ndarray, buckets: int, finish: Callable) -> Callable:
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return finish(None, [])
        rows, found = _chunk(texts, id_column, text_column, size)
        side = np.array(answers.column("bucket").to_pylist(), np.int64)
        whole, asked = _decide(found, answers.filter(pa.array(side >= 0)), hot, buckets)
        # The windows of all documents in one array: those of document d are [at[d], at[d + 1]).
        at = np.concatenate(([0], np.cumsum([max(0, len(t) - size + 1) for t in found.texts], dtype=np.int64)))
        change = np.zeros(at[-1] + 1, np.int8)
        change[at[found.doc[whole]] + found.low[whole]] += 1
        change[at[found.doc[whole]] + found.high[whole]] -= 1
        # The runs of a document don't overlap: each window is in one.
        covered = np.cumsum(change, dtype=np.int8, out=change)[:-1].view(bool)
        second = answers.filter(pa.array(side < 0))
        second = second.set_column(0, "bucket", pa.array(-1 - side[side < 0], pa.int64()))
        side = second.column("bucket").to_numpy()
        for _, _, owner, bucket, doc, start, place in _windows(found, asked, buckets):
            own = pa.array(np.isin(side, bucket))
            code = _answers(second.filter(own), bucket)
            repeated = (found.ids[doc] > owner[place]) | (code[place] == 1)
            covered[at[doc[repeated]] + start[repeated]] = True
        return finish(rows, (cut_text(t, covered[a:b], size) for t, a, b in zip(found.texts, at.tolist(), at[1:].tolist())))

    return run


def _digests(rows: pa.Table | None, cuts: Iterable, id_column: str) -> pa.Table:
    found = [(len(kept) + gone, gone, runs, hashlib.sha256(kept).hexdigest()) for kept, gone, runs in cuts]
    numbers = [pa.array([row[i] for row in found], pa.int64()) for i in range(3)]
    return pa.table({
        "doc_id": (rows.column(id_column).cast(pa.int64()) if rows is not None else pa.array([], pa.int64())),
        "n_bytes": numbers[0], "n_removed": numbers[1], "n_spans": numbers[2],
        "kept_sha256": pa.array([row[3] for row in found], pa.string()),
    })


def _with_cuts(rows: pa.Table, cuts: Iterable, text_column: str) -> pa.Table:
    """The rows with what is left of their texts, made for some rows at a time; a null stays null."""
    valid, parts = rows.column(text_column).is_valid().to_pylist(), []
    pairs = zip(valid, cuts)
    while some := list(islice(pairs, CUT_ROWS)):
        parts.append(pa.array([str(kept, "utf-8", "ignore") if there else None for there, (kept, _, _) in some], pa.string()))
    at = rows.column_names.index(text_column)
    return rows.set_column(at, text_column, pa.chunked_array(parts, pa.string()))


def remove_repeats(docs: DataFrame, size: int = 50, id_column: str = "doc_id", text_column: str = "text",
                   digests: bool = False) -> DataFrame:
    """Remove each byte covered by a window of ``size`` bytes that also starts in a document with a smaller id.

    Windows are judged on the input and never cross documents.  The result has the
    rows and columns of the input with the text cut (a UTF-8 character that loses a
    byte goes whole; a null text stays null), or with ``digests`` the columns doc_id,
    n_bytes, n_removed, n_spans and kept_sha256 of the remaining bytes.  Null and short texts lose nothing.
    A null id is larger than any other; rows with equal ids don't cut each other.
    """
    if size < KEY + 1:
        raise ValueError(f"windows must be longer than {KEY} bytes")
    spark = docs.sparkSession
    columns = docs.columns
    inner_id, inner_text = f"c{columns.index(id_column)}", f"c{columns.index(text_column)}"
    plain = docs.select(id_column, text_column).toDF("c0", "c1") if digests else docs.toDF(*[f"c{i}" for i in range(len(columns))])
    if digests:
        inner_id, inner_text = "c0", "c1"

    volume = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    text_buckets = max(2, round(volume / CHUNK_BYTES))
    name = f"windows_{os.urandom(6).hex()}"
    with small_batches(spark):
        (
            plain.mapInArrow(tidy(chunked(plain, inner_id, inner_text, size)), STORE)
            .write.format("parquet").option("path", scratch_path(spark, "windows")).option("compression", "none")
            .partitionBy("kind").bucketBy(text_buckets, "chunk").saveAsTable(name)
        )
    kept = spark.table(name)
    texts = kept.where(F.col("kind") == TEXT).select("chunk", "data", "entries")
    entries = texts.agg(F.sum("entries")).first()[0] or 0
    buckets = max(2, round(entries / GROUP_ENTRIES))

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                key, many = unpack(data, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(many.astype(np.int64))], names=["key", "n"])

    # At most HOT_SHARE keys can have more than that share of the entries.
    hot_rows = (
        kept.where((F.col("kind") == HEAVY) & (F.col("entries") > 0)).select("data").mapInArrow(heavy, "key long, n long")
        .groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > max(CHUNK_HOT, entries // HOT_SHARE)).select("key")
    )
    hot = np.sort(np.array([r.key for r in hot_rows.collect()], np.int64).view(np.uint64))

    texts = texts.select("chunk", "data")
    asked = texts.mapInArrow(tidy(first_requests(inner_id, inner_text, size, hot, buckets)), MESSAGE)
    first = stored(asked.groupBy("bucket").applyInArrow(tidy_group(first_pass(buckets)), MESSAGE), "windows-first")
    windows = texts.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(
        tidy_cogroup(second_requests(inner_id, inner_text, size, hot, buckets)), MESSAGE
    )
    second = stored(windows.groupBy("bucket").applyInArrow(tidy_group(second_pass), MESSAGE), "windows-second")

    if digests:
        def finish(rows: pa.Table | None, cuts: Iterable) -> pa.Table:
            return _digests(rows, cuts, inner_id)

        result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        empty = plain.limit(0).toArrow().schema

        def finish(rows: pa.Table | None, cuts: Iterable) -> pa.Table:
            return empty.empty_table() if rows is None else _with_cuts(rows, cuts, inner_text)

        result = plain.schema
    out = texts.groupBy("chunk").cogroup(first.union(second).groupBy("chunk")).applyInArrow(
        tidy_cogroup(removal(inner_id, inner_text, size, hot, buckets, finish)), result
    )
    return out if digests else out.toDF(*columns)


def op1_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that a smaller document has too."""
    return remove_repeats(docs)
