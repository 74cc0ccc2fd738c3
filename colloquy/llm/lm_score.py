"""Cross-entropy difference between a target and a background language model.

Both are interpolated bigram models over the same words, counted on all documents:
the background on every document, the target on those that the given condition names.
The models are matched: same vocabulary, same smoothing, and counts of the background
scaled to the target's size.

Counts are exact but for equal 64-bit hashes, and no table of them is held anywhere.
Texts are packed into chunks.  A chunk asks once for each of its n-grams, however often
it has it, so a frequent n-gram has a row's worth of entries a chunk at most.  The asks
meet by ranges of the hash, where the counts of all chunks are summed, and the answers
go back to the chunk in the order of its hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import stored, table

# One part in so many of a word's count is given to every word, seen or not.
WORDS = 1 << 17
PRIOR = 2.0
CHUNK_CHARS = 8 << 20
RANGE_TOKENS = 1 << 20
ASK = "span long, chunk long, n int, body binary"


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of lower-cased words; 0 is kept for the start of a document."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    hashed[hashed == 0] = 1
    return hashed.view(np.int64)


def pair_buckets(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashed words."""
    key = before.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + word.astype(np.int64).view(np.uint64)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (key ^ (key >> np.uint64(31))).view(np.int64)


def histories(words: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), words[:-1])) if len(words) else words


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte, so that the zeros of small numbers lie together."""
    plain = b"".join(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return pa.Codec("zstd").compress(plain, asbytes=True)


def _unpack(body: bytes, n: int, columns: int) -> list[np.ndarray]:
    plain = np.frombuffer(pa.Codec("zstd").decompress(body, n * columns * 8, asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.uint64).reshape(-1) for c in plain]


def chunked(docs: DataFrame) -> DataFrame:
    """``(chunk, ids, sizes, body)`` of all rows ``(id, text)``; the body holds the packed texts."""

    def packed(ids: list, texts: list) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_batch(batch)
        sizes = [len((t or "").lower().encode("utf-8", "surrogatepass").split()) for t in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["ids", "sizes", "body"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                chars += 64 + len(text or "")
                if chars >= CHUNK_CHARS:
                    yield packed(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield packed(ids, texts)

    rows = docs.mapInArrow(run, "ids array<long>, sizes array<long>, body binary")
    return stored(rows.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


def _ngrams(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the hashes of all words, then of all pairs, of a chunk."""
    texts = pa.ipc.open_stream(body).read_all().column(0)
    words = [tokens(t.as_py()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    before = np.concatenate([histories(w) for w in words])
    flat = np.concatenate(words)
    return sizes, before, np.concatenate((flat, pair_buckets(before, flat))).view(np.uint64)


def _asks(chunks: DataFrame, spans: int, counting: bool, answered: bool) -> DataFrame:
    """Rows ``ASK`` of chunks ``(chunk, body, hits)``: for each range the hashes, with counts in the hits and in all texts.

    Hashes are sorted.  A chunk that is only counted gets the number -1 and no answer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, body, hits = (batch.column(k)[at].as_py() for k in range(3))
                sizes, _, both = _ngrams(body)
                keys, place, counts = np.unique(both, return_inverse=True, return_counts=True)
                if not len(keys):
                    continue
                chosen = np.zeros(len(sizes), bool)
                chosen[np.array(hits or [], np.int64)] = True
                chosen = np.repeat(chosen, sizes)
                good = np.bincount(place[np.concatenate((chosen, chosen))], minlength=len(keys))
                if not counting:
                    good, counts = np.zeros_like(good), np.zeros_like(counts)
                span = ((keys >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)).astype(np.int64)
                starts = np.concatenate(([0], np.flatnonzero(np.diff(span)) + 1, [len(keys)]))
                bodies = [
                    _pack(np.diff(keys[a:b], prepend=np.uint64(0)), good[a:b], counts[a:b]) for a, b in zip(starts[:-1], starts[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span[starts[:-1]]), pa.array(np.full(len(bodies), chunk if answered else -1)),
                     pa.array(np.diff(starts).astype(np.int32)), pa.array(bodies, pa.binary())],
                    names=["span", "chunk", "n", "body"],
                )

    return chunks.select("chunk", "body", "hits").mapInArrow(run, ASK)


def _answer(asks: pa.Table) -> pa.Table:
    """Sums of one range, given back to each chunk in the order that it asked."""
    lengths = asks.column("n").to_pylist()
    parts = [_unpack(body.as_py(), n, 3) for body, n in zip(asks.column("body"), lengths)]
    keys, place = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    sums = [np.zeros(len(keys), np.uint64) for _ in range(2)]
    for k, total in enumerate(sums):
        np.add.at(total, place, np.concatenate([p[k + 1] for p in parts]))
    ends = np.cumsum(lengths)
    out = [
        (span, chunk, n, _pack(*(total[place[end - n:end]] for total in sums)))
        for span, chunk, n, end in zip(asks.column("span").to_pylist(), asks.column("chunk").to_pylist(), lengths, ends.tolist()) if chunk >= 0
    ]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["span", "chunk", "n", "body"])


@dataclass
class Models:
    """What the models are counted on: chunks ``(chunk, body, hits)`` and the numbers of words in the hits and in all texts."""

    chunks: DataFrame
    size: int
    whole: int


def _losses(size: int, whole: int, before: np.ndarray, place: np.ndarray, counts: list[np.ndarray]) -> list[np.ndarray]:
    """Loss of each token in the target and in the background model, in nats.

    ``size`` and ``whole`` are the words of the two models, and ``place`` says where the
    counts of all words, then of all pairs, are.
    """
    words, pairs = place[:len(before)], place[len(before):]
    last, out = np.concatenate((words[:1], words[:-1])), []
    scale = size / whole if whole and size else 1.0
    for found, factor, total in zip(counts, (1.0, scale), (size, whole * scale)):
        found = found * factor
        chance = (found[words] + 1 / WORDS) / (total + 1)
        seen = found[pairs]
        known = np.where(before != 0, found[last], seen)
        out.append(-np.log((seen + PRIOR * chance) / (known + PRIOR)))
    return out


def _models(chunks: DataFrame) -> Models:
    """Models of chunks with ``hits``."""
    sums = chunks.select(
        F.expr("aggregate(hits, 0L, (s, i) -> s + sizes[i])").alias("good"), F.expr("aggregate(sizes, 0L, (s, n) -> s + n)").alias("n")
    ).agg(F.sum("good"), F.sum("n")).first()
    return Models(chunks, sums[0] or 0, sums[1] or 0)


def fit(docs: DataFrame) -> Models:
    """Models of rows ``(text, is_target)``."""
    chunks = chunked(docs.select(F.col("is_target").cast("long").alias("id"), "text"))
    return _models(chunks.withColumn("hits", F.expr("filter(sequence(0, size(ids) - 1), i -> ids[i] = 1)")))


def _scored(chunks: DataFrame, asks: DataFrame, models: Models) -> DataFrame:
    size, whole = models.size, models.whole

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [[], [], [], [], []]
        for ids, body in zip(own.column("ids").to_pylist(), own.column("body")):
            sizes, before, both = _ngrams(body.as_py())
            place = np.unique(both, return_inverse=True)[1]
            answers = answers.sort_by("span")
            parts = [_unpack(b.as_py(), n, 2) for b, n in zip(answers.column("body"), answers.column("n").to_pylist())]
            counts = [np.concatenate([np.zeros(0), *(p[k] for p in parts)]) for k in range(2)]
            a, b = _losses(size, whole, before, place, counts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            first, second = (np.bincount(owner, x, minlength=len(sizes)) / np.maximum(sizes, 1) for x in (a, b))
            for column, values in zip(rows, (ids, sizes.tolist(), first.tolist(), second.tolist(), (first - second).tolist())):
                column.extend(values)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table(
            [pa.array(c, kind) for c, kind in zip(rows, kinds)],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    answers = asks.groupBy("span").applyInArrow(_answer, ASK)
    return chunks.select("chunk", "ids", "body").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )


def _spans(models: Models) -> int:
    """Ranges of hashes: as many as keep the entries of each bounded."""
    return max(1, -(-2 * models.whole // RANGE_TOKENS))


def score(docs: DataFrame, models: Models, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` for every row.

    Losses are means over tokens and the score is target minus background: the lower,
    the more like the target.  A null or wordless text has no tokens and three zeros.
    Repeated rows stay; other columns don't matter.
    """
    chunks = chunked(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    tokens_asked = chunks.select(F.expr("aggregate(sizes, 0L, (s, n) -> s + n)").alias("n")).agg(F.sum("n")).first()[0] or 0
    spans = max(_spans(models), -(-2 * tokens_asked // RANGE_TOKENS))
    asks = _asks(models.chunks, spans, True, False).union(
        _asks(chunks.withColumn("hits", F.array().cast("array<int>")), spans, False, True))
    return _scored(chunks, asks, models)


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the text of documents marked as good and not toxic; the background is every document."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("good_id")).distinct()
    chunks = chunked(docs.select(F.col("doc_id").alias("id"), "text"))
    # Both sides grow with the corpus, so the marks always come by a shuffle; the chunks' places are shuffled, not the texts.
    places = chunks.select("chunk", F.posexplode("ids").alias("i", "id"))
    hits = places.join(good.hint("shuffle_merge"), F.col("id") == F.col("good_id")).groupBy("chunk").agg(F.collect_list("i").alias("hits"))
    marked = chunks.join(hits.hint("shuffle_merge"), "chunk", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))
    models = _models(marked)
    return _scored(chunks, _asks(marked, _spans(models), True, True), models)
