"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a label, a non-zero vector of radius + 1 bits.  A table per
non-zero vector v leaves out the bits whose label is orthogonal to v (mod 2).  Any
``radius`` labels have a common orthogonal v, so every pair within the radius meets in
the table that leaves its differing bits out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import stored, table
from colloquy.llm.components import connected_components

BITS = 64
SEED = 42
# A bucket with more fingerprints isn't paired: its members meet over single-bit changes.
BUCKET_PAIRS = 64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())), np.uint64, len(starts)
    )


def fingerprint(text: str | None, size: int) -> int:
    """Bits that are set in over half the hashes; no word at all gives zero."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(marks.view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(
        run, "doc_id long, fp long"
    )


def covering_masks(radius: int) -> list[int]:
    """The structured masks.

    Up to a radius of five the bits are dealt to all labels evenly.  At six there are
    more labels than bits: those with the highest bit set make a first-order
    Reed-Muller code, whose masks keep 32 bits each (one keeps all).
    """
    if not 1 <= radius <= 6:
        raise ValueError("a radius from 1 to 6 is covered")
    vectors = range(1, 1 << (radius + 1))
    label = [1 + bit % len(vectors) if len(vectors) <= BITS else BITS | bit for bit in range(BITS)]
    return [sum(1 << bit for bit in range(BITS) if (label[bit] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_links(marks: DataFrame, radius: int) -> DataFrame:
    """Edges ``(a, b)`` of representatives whose components are those of all pairs within the radius.

    ``marks`` holds different fingerprints: ``(fp, rep)``.  Buckets of few members give
    their verified pairs.  In a larger bucket no pairs are made: each member meets the
    fingerprints that one changed bit of both makes equal, which are exactly those
    at one or two differing bits, and a set of at most 65 is linked as a star.
    """
    if radius > 2:
        raise ValueError("large buckets are resolved for a radius of 2 at most")
    keys = F.explode(
        F.array(*[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for t, m in enumerate(covering_masks(radius))
        ])
    )
    rows = stored(marks.select("fp", "rep", keys.alias("k")).select("fp", "rep", "k.t", "k.key"), "simhash-rows")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes, "simhash-sizes")
    met = stored(rows.join(sizes, ["t", "key"]), "simhash-met")
    few = met.where(F.col("n") <= BUCKET_PAIRS)
    left = few.select("t", "key", F.col("fp").alias("x"), F.col("rep").alias("a"))
    right = few.select("t", "key", F.col("fp").alias("y"), F.col("rep").alias("b"))
    pairs = left.join(right, ["t", "key"]).where(
        (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    ).select("a", "b")
    changed = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << bit)) for bit in range(BITS)])
    many = met.where(F.col("n") > BUCKET_PAIRS).select("fp", "rep").distinct()
    near = (
        many.select("rep", F.explode(F.transform(changed, lambda c: F.col("fp").bitwiseXOR(c))).alias("near"))
        .groupBy("near").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    )
    stars = near.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row.

    A null text counts as empty; texts without words have fingerprint zero and link
    like any other.  Equal fingerprints become one node first, so that copies never
    meet in pairs.  Rows without an id get the component of their fingerprint.
    Repeated rows and ids are kept.
    """
    marked = stored(fingerprints(docs, size, id_column, text_column), "simhash-marks")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    groups = connected_components(near_links(nodes.where("rep IS NOT NULL"), radius))
    placed = nodes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return marked.join(stored(placed, "simhash-placed"), "fp", "left").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
