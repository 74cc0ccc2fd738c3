"""Language identification by inference of a multilingual mixture.

A document's letter trigrams are drawn from a mixture of languages.  Expectation-
maximisation estimates the proportions from the trigram likelihoods of each language;
the set of languages is the one with the best penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import crc_remainder, table

BITS = 15
BUCKETS = 1 << BITS
ROUNDS = 12
UNKNOWN = "und"
STRETCH = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letter trigrams of lower-cased words, word edges included."""
    total = np.zeros(0, np.int64)
    text = (text or "").lower()
    for at in range(0, len(text), STRETCH):
        points = np.frombuffer(text[at:at + STRETCH + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letters()[points]
        if not letters.any():
            continue
        # Every stretch of other characters counts as one space.
        kept = letters | np.concatenate(([False], letters[:-1]))
        line = np.concatenate(([32], np.where(letters, points, 32)[kept], [32])).astype(np.uint64)
        code = line[:-2] * np.uint64(0x9E3779B97F4A7C15) + line[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + line[2:]
        bucket = (code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
        found = np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
        total = found if not len(total) else total + found
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def _batch_counts(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                buckets, counts = trigrams(text.as_py())
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang][buckets] += counts
        for lang, counts in sums.items():
            used = np.append(np.flatnonzero(counts), BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(np.append(counts, 0)[used])],
                names=["lang", "bucket", "n"],
            )

    return docs.select(F.col(text_column), F.col(lang_column)).mapInArrow(run, "lang string, bucket long, n long")


class Languages:
    """Trigram likelihoods of each language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        # A pseudo-count in every bucket, weighted by how common the bucket is in all languages.
        common = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS) if len(names) else np.ones(BUCKETS)
        strength = 500.0
        self.chance = (
            (counts + strength * common) / (counts.sum(axis=1, keepdims=True) + strength)
            if len(names) else np.zeros((0, BUCKETS))
        )

    def mixture(self, chance: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the given languages by expectation-maximisation, and the log likelihood."""
        share, total = np.full(len(chance), 1 / len(chance)), counts.sum()
        for _ in range(ROUNDS):
            owed = counts / (share @ chance)
            share = share * (chance @ owed) / total
        return share, float(counts @ np.log(share @ chance))

    def identify(self, text: str | None) -> tuple[str, float]:
        """The main language of the best set of languages, and its proportion."""
        buckets, counts = trigrams(text)
        if not len(buckets) or not self.names:
            return UNKNOWN, 0.0
        chance = self.chance[:, buckets]
        share, _ = self.mixture(chance, counts)
        # Neighbouring trigrams share letters: three count as one observation in the penalty.
        price = 0.5 * np.log(max(2.0, counts.sum() / 3))
        order = np.argsort(-share, kind="stable")
        alone = np.log(chance) @ counts
        kept, value = np.array([int(np.argmax(alone))]), float(alone.max()) / 3
        kept_share = np.ones(1)
        for size in range(2, len(order) + 1):
            some = np.sort(order[:size])
            own_share, likelihood = self.mixture(chance[some], counts)
            if likelihood / 3 - price * (size - 1) <= value:
                break
            kept, kept_share, value = some, own_share, likelihood / 3 - price * (size - 1)
        main = int(np.argmax(kept_share))
        # How sure: the main language's proportion within the set, scaled by its share among all.
        return self.names[int(kept[main])], float(min(1.0, max(0.0, kept_share[main] * share[kept].sum())))


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Languages:
    """Trigram counts over all given rows with a language (the driver gets a fixed number for each language)."""
    found = _batch_counts(docs.where(F.col(lang_column).isNotNull()), text_column, lang_column)
    rows = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(names), BUCKETS + 1), np.float64)
    place = {name: i for i, name in enumerate(names)}
    counts[[place[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Languages(names, counts[:, :BUCKETS])


def identify(docs: DataFrame, languages: Languages, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row.

    Null, empty and letterless texts are ``und`` with score 0, as is everything when no
    language was learned.  Repeated rows stay; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [languages.identify(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([x for x, _ in said], pa.string()),
                 pa.array([p for _, p in said], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = fit(docs.where(crc_remainder("doc_id", 4) != 2))
    return identify(docs, languages).select(
        "doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )
