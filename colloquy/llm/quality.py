"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

Documents are weighted counts of hashed character trigrams, and four shares that describe
their shape: repeated words, repeated lines, capitals and punctuation.  Trigram weights
come from all documents; the latent space is a truncated decomposition of a bounded,
documented sample of labelled rows.  The sample's vectors are small enough to broadcast, and every
document is compared with all of them in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import crc_remainder, stored, table, tidy

FEATURES = 4096
SHAPES = 4
SHAPE_WEIGHT = 1.5
DIMENSIONS = 48
LABELLED_PER_CLASS = 2000
NEIGHBOURS = 15
BLOCK = 512
SHARPNESS = 8.0


_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_BLANK = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])


def features(text: str | None) -> np.ndarray:
    """Counts of hashed trigrams of the text's bytes, then the shape in thousandths; an empty text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    counts = np.zeros(FEATURES + SHAPES, np.int64)
    for at in range(0, max(0, len(data) - 2), 1 << 20):
        part = data[at:at + (1 << 20) + 2].astype(np.uint32)
        mixed = ((part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)) >> np.uint32(20)
        counts[:FEATURES] += np.bincount(mixed, minlength=FEATURES)
    bytes_of = np.bincount(data, minlength=256)
    letters, blanks = int(bytes_of[_LETTER].sum()), int(bytes_of[_BLANK].sum())
    words, lines = raw.split(), raw.split(b"\n")
    counts[FEATURES:] = [
        1000 * sum(map(eq, words, words[1:])) // max(1, len(words)),
        1000 * (len(lines) - len(set(lines))) // len(lines),
        1000 * int(bytes_of[_CAPITAL].sum()) // max(1, letters),
        1000 * (len(raw) - letters - blanks) // max(1, len(raw)),
    ]
    return counts


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[np.ndarray, int]:
    """How many documents hold each trigram, over all documents (the driver gets FEATURES numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += features(text.as_py())[:FEATURES] > 0
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate(([rows], seen)))], names=["feature", "n"]
        )

    found = docs.select(F.col(text_column).alias("t")).mapInArrow(tidy(run), "feature long, n long")
    out = np.zeros(FEATURES + 1, np.int64)
    for row in found.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[row.feature + 1] = row.n
    return out[1:], int(out[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Trigram counts of at most ``per_class`` labelled documents of each class, chosen by a hash of the id."""
    usable = labels.where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", 3) != 1)
    ).select("doc_id", "quality")
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # Two per_class rows at most.
    held = docs.select("doc_id", "text").join(F.broadcast(stored(chosen, "quality-chosen")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [features(t.as_py()) for t in batch.column(1)]
            where = [np.flatnonzero(c).astype(np.int32) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(where, pa.list_(pa.int32())),
                 pa.array([c[w].astype(np.int32) for c, w in zip(counts, where)], pa.list_(pa.int32()))],
                names=["doc_id", "quality", "feature", "n"],
            )

    rows = held.select("doc_id", "text", "quality").mapInArrow(
        tidy(run), "doc_id long, quality int, feature array<int>, n array<int>")
    # A repeated id counts once, so the bound holds.
    return rows.groupBy("doc_id", "quality").agg(F.first("feature").alias("feature"), F.first("n").alias("n"))


class Voters:
    """Labelled vectors and the map into their space."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, seen: np.ndarray, rows: int):
        self.weight = np.log((1 + rows) / (1 + seen)).astype(np.float32) + np.float32(1)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        weighted = self.weighted(counts)
        rank = min(DIMENSIONS, *weighted.shape) if len(weighted) else 0
        if rank:
            # Randomised subspace iteration; the seed is fixed, so the space is the same each time.
            basis = np.random.default_rng(5).standard_normal((FEATURES, rank + 8)).astype(np.float32)
            for _ in range(4):
                basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
            _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
            self.axes = np.ascontiguousarray((basis @ turn.T)[:, :rank])
        else:
            self.axes = np.zeros((FEATURES, 1), np.float32)
        self.vectors = self.placed(weighted, counts)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts[:, :FEATURES], dtype=np.float32)
        rows *= self.weight
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
        return rows

    def project(self, counts: np.ndarray) -> np.ndarray:
        return self.placed(self.weighted(counts), counts)

    def placed(self, weighted: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit vectors: the latent coordinates and the weighted shape."""
        latent = weighted @ self.axes
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        shape = np.sqrt(counts[:, FEATURES:].astype(np.float32) / 1000) * np.float32(SHAPE_WEIGHT)
        rows = np.concatenate((latent, shape), axis=1)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Labels of the nearest vectors, weighted by similarity; rows without trigrams get the sample's mean label."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.exp(SHARPNESS * np.take_along_axis(near, best, axis=1).astype(np.float64))
        out = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts[:, :FEATURES].any(axis=1), np.clip(out, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS) -> Voters:
    """The classifier of rows whose id's crc32 isn't 1 modulo 3; at most ``per_class`` of each label are kept."""
    seen, rows = document_frequencies(docs)
    sample = labelled_sample(docs, labels, per_class).orderBy("doc_id", "quality").toArrow().combine_chunks()
    counts = np.zeros((sample.num_rows, FEATURES + SHAPES), np.float32)
    for at, (feature, n) in enumerate(zip(sample.column("feature"), sample.column("n"))):
        counts[at, feature.values.to_numpy()] = n.values.to_numpy()
    return Voters(counts, sample.column("quality").to_numpy(), seen, rows)


def score(docs: DataFrame, voters: Voters, id_column: str = "doc_id", text_column: str = "text",
          keep: float | None = None) -> DataFrame:
    """Add a score to every row: (doc_id, score), or the input's rows at or above ``keep``.

    Null and empty texts have no trigrams and get the sample's mean label; repeated
    rows stay; other columns never enter a score.
    """

    def measured(column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(column), BLOCK):
            counts = np.stack([features(t.as_py()) for t in column.slice(at, BLOCK)])
            out.append(voters.scores(counts))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(measured(batch.column(1)))], names=["doc_id", "score"])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measured(batch.column(text_at)) >= keep))

    if keep is None:
        return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(tidy(run), "doc_id long, score double")
    text_at = docs.columns.index(text_column)
    return docs.mapInArrow(tidy(passing), docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of at least one half)."""
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=0.5)
