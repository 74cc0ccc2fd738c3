"""Byte-level BPE encoding and decoding by a table of ranks.

A word is a row of bytes.  The leaves of a segment tree stand for its byte positions: a
leaf holds the rank of the pair that starts there, and a node the leftmost least of its
leaves.  The root names the next merge.  A merge changes three leaves (the pair itself,
the one before it and the one that it swallows), each by one walk to the root.

Short words of about equal length are rows of one matrix of trees and merge together;
a long word has a tree of its own.  Every distinct word is merged once for as long as it
is remembered.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table

# Words of up to so many bytes merge as rows of a matrix.
ROW_BYTES = 64
# Words merged together, and words remembered by a worker; both bound memory only.
ROWS = 20_000
REMEMBERED = 500_000
BATCH_ROWS = 512

_NONE = np.int64(1) << 40
_LATIN = "\x00-\x7fÀ-ÖØ-öø-ɏ"
_NOT_LATIN = re.compile(f"[^{_LATIN}]")
# The public pattern, for texts of ASCII and Latin letters only.
_LATIN_WORD = re.compile(
    r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\t-\r ]|_)+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
# Without these, every space of a text starts a word.
_RUN = re.compile(r"[\t-\r ] ")
_SPACE = re.compile(r"(?= )")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=1)
def _other_class() -> dict[int, str]:
    """Characters that this ``regex`` takes for letters, digits or space and the library does not, or the reverse.

    Each is mapped to a character of the library's class, for splitting only.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out: dict[int, str] = {}
    theirs, ours = {}, {}
    for name, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\n")):
        by_library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs[stand_in] = set(bytes(by_library.encode_ordinary(every)).decode("utf-8"))
        ours[stand_in] = set(regex.findall(name, every))
    for stand_in in theirs:
        out.update((ord(c), "%") for c in ours[stand_in] - theirs[stand_in])
    for stand_in in theirs:
        out.update((ord(c), stand_in) for c in theirs[stand_in] - ours[stand_in])
    return out


def split_words(text: str) -> list[str]:
    """The matches of the public pattern in a text, as the library finds them."""
    if not _NOT_LATIN.search(text):
        return _LATIN_WORD.findall(text)
    other = _other_class()
    if other.keys().isdisjoint(map(ord, set(text))):
        return _pattern().findall(text)
    return [text[m.start():m.end()] for m in _pattern().finditer(text.translate(other))]


class RankCodec:
    """Encoder and decoder of one file of ranks; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            entries = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in entries}
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.written = {str(rank): token for rank, token in self.token_bytes.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        find = self.ranks.get
        pairs = [
            (left << 32 | right, rank)
            for token, rank in self.ranks.items()
            for at in range(1, len(token))
            if (left := find(token[:at])) is not None and (right := find(token[at:])) is not None
        ]
        self.pairs, self.pair_ranks = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        self.decimal = {rank: str(rank) for rank in self.token_bytes}
        self.words: dict[str, str] = {}
        self.stretches: dict[str, str] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(left.shape, _NONE)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], _NONE)

    def merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of up to ``ROW_BYTES`` bytes: one tree for each row of a matrix, one merge of every row a pass."""
        sizes = np.array([len(w) for w in words])
        width = 1 << max(0, int(sizes.max()) - 1).bit_length()
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids = self.byte_ids[raw]
        after = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), ids.shape).copy()
        tree = np.full((len(words), 2 * width), _NONE * width)
        if width > 1:
            places = np.arange(width - 1)
            inside = places + 1 < sizes[:, None]
            keys = self._rank(ids[:, :-1], ids[:, 1:]) * width + places
            tree[:, width:-1] = np.where(inside, keys, _NONE * width)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(rows: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = key
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(len(words))
        while True:
            least = tree[rows, 1]
            more = least < _NONE * width
            rows, least = rows[more], least[more]
            if not len(rows):
                break
            at = least % width
            gone = after[rows, at]
            follower = after[rows, gone]
            ids[rows, at] = least // width
            after[rows, at] = follower
            ids[rows, gone] = -1
            put(rows, gone, _NONE * width)
            has = follower < sizes[rows]
            own, here, there = rows[has], at[has], follower[has]
            before[own, there] = here
            key = np.full(len(rows), _NONE * width)
            key[has] = self._rank(ids[own, here], ids[own, there]) * width + here
            put(rows, at, np.minimum(key, _NONE * width))
            leader = before[rows, at]
            has = leader >= 0
            own, here, there = rows[has], leader[has], at[has]
            put(own, here, np.minimum(self._rank(ids[own, here], ids[own, there]) * width + here, _NONE * width))
        live = (ids >= 0) & (np.arange(width) < sizes[:, None])
        ends = np.cumsum(live.sum(axis=1)).tolist()
        flat = ids[live].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one word of any length, by a tree of its own."""
        size, find = len(word), self.ranks.get
        width = 1 << max(0, size - 1).bit_length()
        none = 1 << 80
        tree = [none] * (2 * width)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        for at in range(size - 1):
            if (rank := find(word[at:at + 2])) is not None:
                tree[width + at] = rank * width + at
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

        def put(leaf: int, key: int) -> None:
            node = leaf + width
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                key = key if key < other else other
                node >>= 1
                if tree[node] == key:
                    return
                tree[node] = key

        def pair(start: int) -> int:
            """The key of the pair that starts here."""
            middle = after[start]
            if middle >= size or (rank := find(word[start:after[middle]])) is None:
                return none
            return rank * width + start

        while tree[1] < none:
            at = tree[1] % width
            gone = after[at]
            follower = after[at] = after[gone]
            if follower < size:
                before[follower] = at
            put(gone, none)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        out, at = [], 0
        while at < size:
            out.append(self.ranks[word[at:after[at]]])
            at = after[at]
        return out

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token is that token."""
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                out[at] = [rank]
            elif len(word) > ROW_BYTES:
                out[at] = self.merge_word(word)
            elif word:
                by_width.setdefault((len(word) - 1).bit_length(), []).append(at)
        for places in by_width.values():
            for start in range(0, len(places), ROWS):
                part = places[start:start + ROWS]
                for at, ids in zip(part, self.merge_rows([words[i] for i in part])):
                    out[at] = ids
        return out

    def _learn(self, words: set[str], stretches: set[str]) -> None:
        split = {stretch: _LATIN_WORD.findall(stretch) for stretch in stretches}
        fresh = list(words.union(*split.values()) - self.words.keys())
        decimal = self.decimal.__getitem__
        for word, ids in zip(fresh, self.merged([w.encode("utf-8") for w in fresh])):
            self.words[word] = " ".join(map(decimal, ids))
        known = self.words.__getitem__
        for stretch, parts in split.items():
            self.stretches[stretch] = known(parts[0]) if len(parts) == 1 else " ".join(map(known, parts))

    def encode_written(self, texts: list[str | None]) -> list[str]:
        """The ids of each text in decimal, joined by one space; a null counts as empty.

        A plain text is cut before each space; the ids of such stretches are remembered too.
        """
        if len(self.stretches) + len(self.words) > 2 * REMEMBERED:
            self.stretches, self.words = {}, {}
        cut, words, stretches = [], set(), set()
        for text in texts:
            if not text:
                cut.append((self.words, []))
            elif _NOT_LATIN.search(text) or _RUN.search(text):
                cut.append((self.words, parts := split_words(text)))
                words.update(parts)
            else:
                parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _SPACE.split(text)
                cut.append((self.stretches, parts if parts[0] else parts[1:]))
                stretches.update(cut[-1][1])
        self._learn(words, stretches - self.stretches.keys())
        return [" ".join(map(known.__getitem__, parts)) for known, parts in cut]

    def decode_written(self, ids: str) -> bytes:
        return b"".join(map(self.written.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> RankCodec:
    """The codec of a worker process; without a path, the ranks installed on that machine."""
    return RankCodec(path or default_ranks())


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for at in range(0, batch.num_rows, BATCH_ROWS):
        part = batch.slice(at, BATCH_ROWS)
        yield part.column(0).cast(pa.int64()), part.column(column).to_pylist()


def encoded(docs: DataFrame, ranks: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)``: one row per input row; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for ids, texts in _texts(batch, 1):
                rows = [list(map(int, written.split())) for written in own.encode_written(texts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ranks: str | None = None) -> DataFrame:
    """``(doc_id, bytes)`` of rows ``(doc_id, ids)``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = codec(ranks).token_bytes.__getitem__
        for batch in batches:
            raw = [b"".join(map(token, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.binary())],
                                             names=["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trips(docs: DataFrame, ranks: str | None = None, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, without moving either off the task.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per input row; a null
    text counts as empty.  Repeated rows stay, other columns don't matter, an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for ids, texts in _texts(batch, 1):
                written = own.encode_written(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([w.count(" ") + 1 if w else 0 for w in written], pa.int64()),
                     pa.array([hashlib.sha256(w.encode("ascii")).hexdigest() for w in written], pa.string()),
                     pa.array([hashlib.sha256(own.decode_written(w)).hexdigest() for w in written], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_rank_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
