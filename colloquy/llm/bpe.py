"""Byte-level BPE encoding and decoding with a public vocabulary file.

Short words hold their parts and the ranks of adjacent parts in contiguous arrays: the
smallest rank is found by a scan, its boundary deleted and the ranks on both sides
refreshed.  Words of equal length do this together, as the rows of one matrix.  Long
words take the same merges from a heap of ranks.

A column of texts is cut at its spaces by Arrow, and each distinct piece and word is
merged once; no table of words outlives a few megabytes of text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table

# The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ANY = regex.compile(PATTERN)
# The same split for texts in which letters, digits and white space mean the same to ``re``.
_PLAIN = re.compile(r"""[^\W\d_]+| [^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+| ?\d+|\s+(?!\S)|\s+""")
_NOT_PLAIN = re.compile("[^\\t\\n\\r -~¡-±´-¸º»¿-ɀ]")
# In a plain text without these, every space starts a word and the pieces between spaces split on their own.
_RUNS = ("  ", "\n ", "\t ", "\r ")

SHORT_BYTES = 48
CACHED_WORDS = 500_000
COLUMN_BYTES = 4 << 20
_NONE = np.iinfo(np.int32).max


def split_words(text: str) -> list[str]:
    """Words before merging.  Characters that this Python's tables don't know are left to the library's own split."""
    if not _NOT_PLAIN.search(text):
        return _PLAIN.findall(text)
    if any(category(c) == "Cn" for c in set(text)):
        from tokenizers.pre_tokenizers import ByteLevel

        spans = ByteLevel(add_prefix_space=False, trim_offsets=False).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]
    return _ANY.findall(text)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@contextmanager
def no_cycle_search():
    """Work that makes millions of small lists and no cycles needs no search for cycles meanwhile."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_alphabet()
        value = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocabulary[c] for c in letters]
        self.token_bytes: dict[int, bytes] = {i: bytes(map(value.__getitem__, t)) for t, i in vocabulary.items()}
        self.token_bytes.update({i: t.encode("utf-8") for t, i in self.special.items()})
        pairs, merged = [], []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append(vocabulary[left] << 32 | vocabulary[right])
            merged.append(vocabulary[left + right])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.merged = np.array(merged, np.int32)
        by_pair = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.pair_ranks = np.array(pairs, np.int64)[by_pair], by_pair.astype(np.int32)
        self.byte_array = np.array(self.byte_ids, np.int32)
        each = self.byte_array.astype(np.int64)
        self.byte_pair_ranks = self._rank(np.repeat(each, 256), np.tile(each, 256))
        # Ids as little-endian 32-bit numbers.
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        special = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = re.compile(special) if special else None
        # Texts that are not cut at every space and nowhere else.
        self.odd = "|".join(filter(None, (_NOT_PLAIN.pattern, *_RUNS, special)))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], np.int32(_NONE))

    def merge_rows(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups ``(rows, ids)`` of a matrix of bytes, a word a row.  Each pass deletes one boundary of every word that still has a merge."""
        parts, rows = self.byte_array[raw], np.arange(len(raw))
        near = self.byte_pair_ranks[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        while len(rows):
            each = np.arange(len(rows))
            if parts.shape[1] == 1:
                yield rows, parts
                return
            at = near.argmin(axis=1)
            least = near[each, at]
            if (over := least == _NONE).any():
                yield rows[over], parts[over]
                rows, parts, near, at, least = (x[~over] for x in (rows, parts, near, at, least))
                if not len(rows):
                    return
                each = np.arange(len(rows))
            width = parts.shape[1] - 1
            parts[each, at] = whole = self.merged[least]
            stays = np.ones(parts.shape, bool)
            stays[each, at + 1] = False
            parts = parts[stays].reshape(len(rows), width)
            stays = np.ones(near.shape, bool)
            stays[each, at] = False
            near = near[stays].reshape(len(rows), width - 1)
            left, right = each[at > 0], each[at < width - 1]
            near[left, at[left] - 1] = self._rank(parts[left, at[left] - 1], whole[left])
            near[right, at[right]] = self._rank(whole[right], parts[right, at[right] + 1])

    def merge_equal(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of one length."""
        out: list = [None] * len(words)
        for rows, ids in self.merge_rows(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)):
            step, raw = 4 * ids.shape[1], ids.astype("<i4").tobytes()
            for at, row in enumerate(rows.tolist()):
                out[row] = raw[at * step:(at + 1) * step]
        return out

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words into the table of known words."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8")
            by_length.setdefault(len(raw), []).append((word, raw))
        for length, group in by_length.items():
            if length > SHORT_BYTES:
                self.words.update((word, self.merge_long(raw)) for word, raw in group)
            else:
                self.words.update(zip((w for w, _ in group), self.merge_equal([r for _, r in group])))

    def merge_long(self, word: bytes) -> bytes:
        parts = [self.byte_ids[b] for b in word]
        find, merged, n = self.ranks.get, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := find(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or find(parts[i] << 32 | parts[j]) != rank:
                continue
            parts[i], parts[j] = int(merged[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := find(parts[i] << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := find(parts[h] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([p for p in parts if p >= 0], "<i4").tobytes()

    def _pieces(self, text: str) -> list[str | int]:
        """The text between special tokens, and the ids of those."""
        out, at = [], 0
        while self.cut is not None and (found := self.cut.search(text, at)):
            out += [text[at:found.start()], self.special[found.group()]]
            at = found.end()
        return [*out, text[at:]]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; strings of special tokens become their ids, a null has no ids.

        The tables of known words and of known pieces between spaces are emptied when
        full, so their size is bounded.
        """
        with no_cycle_search():
            return self._encode_batch(texts)

    def _encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) + len(self.spaced) > 2 * CACHED_WORDS:
            self.words, self.spaced = {}, {}
        plans, heads, tails = [], set(), set()
        for text in texts:
            plan = []
            for piece in self._pieces(text) if text else ():
                if isinstance(piece, int):
                    plan.append(piece)
                elif _NOT_PLAIN.search(piece) or any(run in piece for run in _RUNS):
                    plan.append((words := split_words(piece), ()))
                    heads.update(words)
                else:
                    first, *rest = piece.split(" ")
                    plan.append((words := _PLAIN.findall(first), rest))
                    heads.update(words)
                    tails.update(rest)
            plans.append(plan)
        tails -= self.spaced.keys()
        split = {tail: _PLAIN.findall(" " + tail) for tail in tails}
        heads.update(*split.values())
        self.learn(heads - self.words.keys())
        word, spaced = self.words.__getitem__, self.spaced
        for tail, words in split.items():
            spaced[tail] = word(words[0]) if len(words) == 1 else b"".join(map(word, words))
        tail_ids, out = spaced.__getitem__, []
        for plan in plans:
            raw = b"".join(
                step.to_bytes(4, "little") if isinstance(step, int)
                else b"".join(chain(map(word, step[0]), map(tail_ids, step[1])))
                for step in plan
            )
            out.append(np.frombuffer(raw, "<i4"))
        return out

    def _merge_all(self, words: pa.Array) -> pa.Array:
        """Lists of the ids of distinct words."""
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int32)[:len(words) + 1] if len(words) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        starts, lengths = ends[:-1], np.diff(ends)
        by_length = np.argsort(lengths, kind="stable")
        widths, firsts = np.unique(lengths[by_length], return_index=True)
        counts, found = np.zeros(len(words), np.int64), []
        for width, rows in zip(widths.tolist(), np.split(by_length, firsts[1:])):
            if width > SHORT_BYTES:
                groups = ((rows[i:i + 1], np.frombuffer(self.merge_long(data[a:a + width].tobytes()), "<i4")[None])
                          for i, a in enumerate(starts[rows].tolist()))
            else:
                groups = ((rows[own], ids) for own, ids in self.merge_rows(data[starts[rows][:, None] + np.arange(width)]))
            for own, ids in groups:
                counts[own] = ids.shape[1]
                found.append((own, ids))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(offsets[-1], np.int32)
        for own, ids in found:
            flat[offsets[own][:, None] + np.arange(ids.shape[1])] = ids
        return pa.ListArray.from_arrays(offsets.astype(np.int32), flat)

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode_column`` of texts in which every space starts a word."""
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()
        pieces = cut.flatten().dictionary_encode()
        items, distinct = pieces.indices.to_numpy().astype(np.int32), pieces.dictionary
        # Steps: pieces that are one word, other pieces, and the texts' first pieces, which follow no space.
        first = pc.take(distinct, pa.array(items[starts[:-1]])).dictionary_encode()
        alone = pc.utf8_is_alpha(distinct)
        is_alone = alone.to_numpy(zero_copy_only=False)
        rest = [_PLAIN.findall(" " + piece) for piece in distinct.filter(pc.invert(alone)).to_pylist()]
        rest += map(_PLAIN.findall, first.dictionary.to_pylist())
        n, n_alone = len(distinct), int(is_alone.sum())
        step = np.where(is_alone, np.cumsum(is_alone) - 1, n_alone + np.cumsum(~is_alone) - 1).astype(np.int32)[items]
        step[starts[:-1]] = n + first.indices.to_numpy()
        spaced = pc.binary_join_element_wise("", distinct.filter(alone), " ")
        words = pa.concat_arrays([spaced, pa.array(list(chain.from_iterable(rest)), pa.string())]).dictionary_encode()
        ids = self._merge_all(words.dictionary).take(words.indices)
        ends = np.concatenate((np.arange(n_alone + 1), n_alone + np.cumsum([len(x) for x in rest], dtype=np.int64)))
        steps = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[ends], pa.int32()), ids.flatten())
        found = steps.take(pa.array(step))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[starts].astype(np.int64)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode_plain(texts)
        ids, ends = self._encode_plain(texts.filter(pa.array(~odd)))
        out: list = [None] * len(odd)
        for at, own in zip(np.flatnonzero(~odd).tolist(), np.split(ids, ends[1:-1])):
            out[at] = own
        for at, own in zip(np.flatnonzero(odd).tolist(), self.encode_batch(texts.filter(pa.array(odd)).to_pylist())):
            out[at] = own
        return np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def forget(self) -> None:
        """Drop the known words: a worker that waits for another job holds no memory for them."""
        self.words, self.spaced = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``(id, text)`` cut into ones of a few megabytes of text; a longer text is one of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, before + COLUMN_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    """The codec of a worker process; without a path, the vocabulary installed on that machine."""
    return Codec(path or default_vocabulary())


def encoded(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)``: one row per input row; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part in text_slices(batches):
            ids, ends = own.encode_column(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], names=["doc_id", "ids"])
        own.forget()

    return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocabulary).decode
        for batch in batches:
            texts = pa.array([decode(i.as_py() or []) for i in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), texts], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Digests of the ids and of the text decoded from them, without moving either off the task.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per input row; a null
    text counts as empty.  Repeated rows stay, other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        written = {i: str(i) for i in own.token_bytes}
        for batch in text_slices(batches):
            counts, ids_digests, text_digests = [], [], []
            flat, ends = own.encode_column(batch.column(1))
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                ids = flat[start:end].tolist()
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()),
                 pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        own.forget()

    return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
