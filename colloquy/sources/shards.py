"""JSON array shards to records, whatever their size.

A shard is one JSON array; its elements are the records.  The text source cuts files at
closing braces, so one shard is read by many tasks (splits).  What a split means depends
on two things that lie before it: whether it starts inside a string, and how deep.

* First read: each split is summed up in one small row for both kinds of start: change of
  depth, lowest and highest depth, and the elements that end at each depth.
* Composition: running sums over the rows of a shard give every split its real start, and
  say whether the shard is one array.
* Second read: knowing its start, a split emits its records in place.
* Third read, only where a shard has several splits: the ends of splits.  A record that
  lies across an edge is put together from them; nothing else is shuffled.

A malformed element is refused alone, later; a shard that is not one array is refused as
a whole.  No size changes the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.session import fixed_splits, materialize

JSON_SPACE = b" \t\n\r\x0c"
# Records leave a task in batches of about so many bytes or rows.
EMIT_BYTES, EMIT_ROWS = 4 << 20, 2_000

_QUOTE, _OPEN, _CLOSE, _COMMA = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[ord('"')] = _QUOTE
_KIND[[ord("["), ord("{")]] = _OPEN
_KIND[[ord("]"), ord("}")]] = _CLOSE
_KIND[ord(",")] = _COMMA
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(JSON_SPACE)] = True
_FAR = 1 << 40


# ------------------------------------------------------------------ marks in bytes


def marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and kinds of brackets and commas, the number of quotes before each and of all, modulo 2.

    A quote after an odd run of backslashes is part of a string and doesn't count.
    """
    kind = _KIND[raw]
    at = np.flatnonzero(kind)
    kind = kind[at]
    quote = kind == _QUOTE
    back = np.flatnonzero(raw == 92)
    if len(back):
        quotes = at[quote]
        behind = np.searchsorted(back, quotes) - 1
        near = (behind >= 0) & (back[np.maximum(behind, 0)] == quotes - 1)
        run = np.arange(len(back)) - np.maximum.accumulate(np.where(np.diff(back, prepend=-2) > 1, np.arange(len(back)), 0))
        escaped = near & (run[np.maximum(behind, 0)] % 2 == 0)
        quote[quote] = ~escaped
        keep = quote | (kind != _QUOTE)
        at, kind, quote = at[keep], kind[keep], quote[keep]
    parity = np.cumsum(quote) & 1
    other = ~quote
    return at[other], kind[other], parity[other], int(parity[-1]) if len(parity) else 0


def _ends_element(raw: np.ndarray, commas: np.ndarray) -> np.ndarray:
    """Whether each comma follows something: neither a comma nor an opening bracket."""
    before = commas - 1
    last = np.where(before >= 0, raw[np.maximum(before, 0)], ord("}"))
    if _IS_SPACE[last].any():
        solid = np.flatnonzero(~_IS_SPACE[raw])
        found = np.searchsorted(solid, commas) - 1
        last = np.where(found >= 0, raw[solid[np.maximum(found, 0)]] if len(solid) else 0, ord("}"))
    return (last != ord(",")) & (last != ord("["))


# --------------------------------------------------------------------- first read


class _Summary:
    """What a split does, for a start outside (0) and inside (1) a string."""

    def __init__(self, shard: str, block: int, length: int):
        self.shard, self.block, self.length = shard, block, length
        self.parity, self.opens, self.seen = 0, False, False
        self.delta, self.deepest = [0, 0], [-_FAR, -_FAR]
        self.low, self.low_before_end, self.tail_ok = [_FAR, _FAR], [_FAR, _FAR], [False, False]
        self.ends: list[dict[int, int]] = [{}, {}]

    def add(self, chunk: bytes) -> None:
        raw = np.frombuffer(chunk, np.uint8)
        if not self.seen:
            head = chunk.lstrip(JSON_SPACE)
            self.seen, self.opens = bool(head), head[:1] == b"["
        at, kind, inside, quotes = marks(raw)
        for start in (0, 1):
            outside = (inside ^ (self.parity ^ start)) == 0
            places, kinds = at[outside], kind[outside]
            depth = self.delta[start] + np.cumsum((kinds == _OPEN).astype(np.int64) - (kinds == _CLOSE))
            bracket = kinds != _COMMA
            after = depth[bracket]
            if len(after):
                self.low_before_end[start] = min(self.low[start], int(after[:-1].min(initial=_FAR)))
                self.low[start] = min(self.low[start], int(after.min()))
                self.deepest[start] = max(self.deepest[start], int(after.max()))
                self.delta[start] = int(after[-1])
                last = int(places[bracket][-1])
                self.tail_ok[start] = chunk[last:last + 1] == b"]" and not chunk[last + 1:].strip(JSON_SPACE)
            elif chunk.strip(JSON_SPACE):
                self.tail_ok[start] = False
            commas = ~bracket
            own = places[commas]
            if len(own):
                values, counts = np.unique(depth[commas][_ends_element(raw, own)], return_counts=True)
                for value, count in zip(values.tolist(), counts.tolist()):
                    self.ends[start][value] = self.ends[start].get(value, 0) + count
        self.parity ^= quotes

    def row(self) -> dict:
        out = {"shard_name": self.shard, "block": self.block, "length": self.length, "parity": self.parity, "opens": self.opens}
        for name in ("delta", "low", "low_before_end", "deepest", "tail_ok"):
            out[name] = getattr(self, name)
        return out | {"ends": [[{"depth": d, "n": n} for d, n in sorted(e.items())] for e in self.ends]}


_SUMMARY = """shard_name string, block bigint, length bigint, parity bigint, opens boolean, delta array<bigint>, low array<bigint>,
  low_before_end array<bigint>, deepest array<bigint>, tail_ok array<boolean>, ends array<array<struct<depth: bigint, n: bigint>>>"""
_ARROW_SUMMARY = pa.schema([
    ("shard_name", pa.string()), ("block", pa.int64()), ("length", pa.int64()), ("parity", pa.int64()), ("opens", pa.bool_()),
    ("delta", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("low_before_end", pa.list_(pa.int64())),
    ("deepest", pa.list_(pa.int64())), ("tail_ok", pa.list_(pa.bool_())),
    ("ends", pa.list_(pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())])))),
])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bool, bytes]]:
    """``(batch, row, is_new, bytes)``: the bytes of a split in order, without the brace that ends it.

    Rows are ``(shard_name, block, length, piece, ...)`` in file order; a new split begins
    where name or block changes.
    """
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names, blocks = pc.dictionary_encode(batch.column(0)), batch.column(1).to_numpy()
        codes = names.indices.to_numpy()
        starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = names.dictionary[int(codes[a])].as_py(), int(blocks[a])
            pieces = batch.column(3).slice(a, b - a).to_pylist()
            fresh = key != before
            yield batch, a, fresh, (b"" if fresh else b"}") + b"}".join(pieces)
            before = key


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Summary | None = None
    for batch, row, fresh, chunk in _chunks(batches):
        if fresh:
            if now is not None:
                yield pa.RecordBatch.from_pylist([now.row()], _ARROW_SUMMARY)
            now = _Summary(*(batch.column(i)[row].as_py() for i in range(3)))
        now.add(chunk)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], _ARROW_SUMMARY)


# -------------------------------------------------------------------- composition


def compose(summaries: DataFrame, depth_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The start of every split of a good shard, and the shards that are not one JSON array.

    Starts are ``(shard_name, block, length, good, start, depth, base, is_first, is_last)``:
    whether the shard is kept, inside a string or not, the depth, and the elements that end
    before the split.
    """
    order = Window.partitionBy("shard_name").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def earlier(c: str) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    def own(c: str) -> Column:
        return F.get(c, F.col("start").cast("int"))

    rows = summaries.withColumns({
        "start": earlier("parity") % 2,
        "is_first": F.lag("block").over(order).isNull(),
        "is_last": F.lead("block").over(order).isNull(),
    })
    # The brace after a split belongs to it, except at the end of the file.
    brace = ~F.col("is_last") & ((F.col("start") + F.col("parity")) % 2 == 0)
    rows = rows.withColumn("change", own("delta") - brace.cast("bigint")).withColumn("depth", earlier("change"))
    at_top = F.filter(own("ends"), lambda e: e["depth"] == 1 - F.col("depth"))
    rows = rows.withColumn("n", F.coalesce(F.get(at_top, F.lit(0))["n"], F.lit(0))).withColumn("base", earlier("n"))

    inner = F.least(own("low"), F.when(brace, F.col("change")))
    lowest = F.col("depth") + F.when(F.col("is_last"), own("low_before_end")).otherwise(inner)
    closed = (F.col("depth") + F.col("change") == 0) & own("tail_ok") & ((F.col("start") + F.col("parity")) % 2 == 0)
    deepest = F.max(F.col("depth") + own("deepest"))
    shape = rows.groupBy("shard_name").agg(
        (F.bool_and(lowest >= 1) & F.bool_and(~F.col("is_last") | closed) & F.bool_and(~F.col("is_first") | F.col("opens"))).alias("one"),
        (F.lit(False) if depth_limit is None else deepest > depth_limit).alias("too_deep"),
    )
    shape = shape.withColumn("good", F.col("one") & ~F.col("too_deep"))
    malformed = shape.where(~F.col("good")).select(
        "shard_name", F.when(F.col("too_deep"), "RESOURCE_LIMIT").otherwise("MALFORMED_JSON").alias("reason"))
    starts = rows.join(shape.select("shard_name", "good"), "shard_name").select(
        "shard_name", "block", "length", "good", "start", "depth", "base", "is_first", "is_last")
    return starts, malformed


# ------------------------------------------------------------ second and third read


class _Cutter:
    """Cuts one split whose start is known into elements."""

    def __init__(self, start: int, depth: int, base: int, is_first: bool, is_last: bool):
        self.inside, self.depth, self.ordinal = start, depth, base
        self.is_first, self.is_last = is_first, is_last
        self.open: list[bytes] = []
        self.headless = not is_first
        self.head: tuple[int, bytes] | None = None

    def add(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        """``(ordinal, element)`` of elements that begin and end in this split."""
        raw = np.frombuffer(chunk, np.uint8)
        at, kind, inside, quotes = marks(raw)
        outside = (inside ^ self.inside) == 0
        at, kind = at[outside], kind[outside]
        depth = self.depth + np.cumsum((kind == _OPEN).astype(np.int64) - (kind == _CLOSE))
        # Elements lie between commas of the array and its own two brackets.
        cut = ((kind != _CLOSE) & (depth == 1)) | ((kind == _CLOSE) & (depth == 0))
        begin = 0
        for place in at[cut].tolist():
            self.open.append(chunk[begin:place])
            element = b"".join(self.open)
            self.open, begin = [], place + 1
            if self.headless:
                # It began in an earlier split, maybe inside a string, and stays as it is.
                self.head, self.headless = (self.ordinal, element), False
                self.ordinal += 1
            elif element := element.strip(JSON_SPACE):
                yield self.ordinal, element
                self.ordinal += 1
        self.open.append(chunk[begin:])
        self.inside ^= quotes
        if len(depth):
            self.depth = int(depth[-1])

    def edges(self) -> Iterator[tuple[int, bytes]]:
        """Parts of elements that lie across the split's edges."""
        if self.head is not None:
            yield self.head
        if not self.is_last:
            yield self.ordinal, b"".join(self.open) + b"}"


def _emit(edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, cutter = "", 0, None
        names, blocks, ordinals, records, size = [], [], [], [], 0

        def put(ordinal: int, record: bytes) -> None:
            names.append(shard)
            blocks.append(block)
            ordinals.append(ordinal)
            records.append(record)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(blocks, pa.int64()), pa.array(ordinals, pa.int64()), pa.array(records, pa.binary())],
                names=["shard_name", "block", "shard_ordinal", "record"])
            for part in (names, blocks, ordinals, records):
                part.clear()
            return out

        for batch, row, fresh, chunk in _chunks(batches):
            if fresh:
                if edges and cutter is not None:
                    for ordinal, record in cutter.edges():
                        put(ordinal, record)
                shard, block = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                known = [batch.column(i)[row].as_py() for i in range(4, 9)]
                if None in known:
                    raise RuntimeError("the splits of a file changed between two reads")
                cutter = _Cutter(*known)
            for ordinal, record in cutter.add(chunk):
                if edges:
                    continue
                put(ordinal, record)
                size += len(record)
                if size >= EMIT_BYTES or len(records) >= EMIT_ROWS:
                    yield flush()
                    size = 0
        if edges and cutter is not None:
            for ordinal, record in cutter.edges():
                put(ordinal, record)
        if records:
            yield flush()

    return run


def pieces(files: DataFrame, shard_name: Column | None = None) -> DataFrame:
    """``(shard_name, block, length, piece)`` of a text source that cuts at closing braces; rows of a split stay in order."""
    name = F.col("_metadata.file_name") if shard_name is None else shard_name
    return files.select(
        name.alias("shard_name"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("piece"))


def file_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pieces of files.  Their plan keeps the split sizes of now, so that every read cuts alike."""
    return pieces(fixed_splits(spark).read.text(paths, lineSep="}"))


def text_pieces(texts: DataFrame, split_bytes: int) -> DataFrame:
    """Pieces of shards that are rows ``(shard_name, text)``, as files of theirs cut after about ``split_bytes`` would give them.

    A row is a whole split, so neither files nor a listing are needed for each shard.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, start = (text.as_py() or "").encode("utf-8", "surrogatepass"), 0
                while start < len(raw):
                    brace = raw.find(b"}", start + split_bytes - 1)
                    end = len(raw) if brace < 0 else brace + 1
                    # The brace that ends a split isn't part of its piece.
                    piece = raw[start:end - 1] if raw[end - 1:end] == b"}" else raw[start:end]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.string()), pa.array([start], pa.int64()), pa.array([split_bytes], pa.int64()),
                         pa.array([piece], pa.binary())], names=["shard_name", "block", "length", "piece"])
                    start = end

    return texts.select("shard_name", "text").mapInArrow(cut, "shard_name string, block bigint, length bigint, piece binary")


def scan(read: DataFrame, depth_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records ``(shard_name, shard_ordinal, record)`` of the pieces, and shards ``(shard_name, reason)`` that are refused.

    Elements are numbered in order; nothing between two commas is no element.  With a
    ``depth_limit``, a shard that nests deeper is refused.  One row a split is broadcast
    (input size over ``spark.sql.files.maxPartitionBytes``).
    """
    summaries = materialize(read.mapInArrow(_summaries, _SUMMARY), "split-summaries")
    starts, malformed = compose(summaries, depth_limit)

    def records(edges: bool) -> DataFrame:
        joined = read.join(F.broadcast(starts), ["shard_name", "block", "length"], "left").where("good IS NULL OR good")
        if edges:
            joined = joined.where("NOT (is_first AND is_last)")
        known = joined.select("shard_name", "block", "length", "piece", "start", "depth", "base", "is_first", "is_last")
        return known.mapInArrow(_emit(edges), "shard_name string, block bigint, shard_ordinal bigint, record binary")

    found = records(False).select("shard_name", "shard_ordinal", F.col("record").cast("string").alias("record"))
    if summaries.where("block > 0").limit(1).count():
        part = F.struct("block", F.col("record").cast("string").alias("part"))
        across = records(True).groupBy("shard_name", "shard_ordinal").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "").alias("record"))
        space = JSON_SPACE.decode("ascii")
        found = found.unionByName(across.withColumn("record", F.trim("record", F.lit(space))).where("record <> ''"))
    return found, malformed
