"""Exact duplicates by a distributed content sort (DataFrame functions only).

Sampled splitters range-partition the rows by the first characters of the normalised
text, an external sort places equal texts next to each other, and the window compares
neighbours in full.  A text that holds more than a thousandth of the rows is sorted in
chunks; the winners of its chunks (two thousand at most, whatever the input) are
compared with each other afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import stored, table, text_or_empty

# The white space that doesn't count.
WHITE_SPACE = " \t\n\x0b\x0c\r"
PREFIX = 24
HOT_SHARE = 1000


def normalised(text_column: str = "text"):
    return F.translate(text_or_empty(text_column), WHITE_SPACE, "")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and ``row``, the input, if carried).

    Texts are equal when they are identical without white space; a null counts as
    empty.  The row with the most code points stays, then the smallest id (a null id
    comes last).  Of rows that are alike in both, one stays.  An empty table gives an
    empty result; other columns don't matter, whatever their names.
    """
    base = docs.select(
        F.col(id_column).alias("doc_id"),
        normalised(text_column).alias("norm"),
        F.char_length(text_or_empty(text_column)).alias("points"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    ).withColumn("h", F.xxhash64("norm"))
    limit = max(1, docs.count() // HOT_SHARE)
    # At most HOT_SHARE hashes have more rows than this, so the table may be broadcast.
    hot = stored(base.groupBy("h").agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > limit), "exact-hot")

    def chunked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("hot_rows") / limit)), F.lit(0)))

    def ranked(dealt: DataFrame, *carried: str) -> DataFrame:
        """Rows that are dealt by prefix, hash and chunk, each with its place among its equals there."""
        equal = Window.partitionBy("prefix", "h", "chunk", "norm")
        order = equal.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
        return dealt.select(
            "doc_id", "chunk", "points", "norm", "hot_rows", *carried,
            F.row_number().over(order).alias("place"),
            F.first("doc_id").over(order).alias("leader"),
            F.count("*").over(equal).alias("copies"),
        ).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))

    first = F.col("place") == 1
    # Chunks of hot texts agree on their winner first: one row a text and chunk.
    winners = ranked(chunked(base.drop("row").join(F.broadcast(hot), "h")).withColumn("prefix", F.lit("")).repartition("h", "chunk")).where(first)
    same = Window.partitionBy("text_sha256", "norm")
    best = same.orderBy(F.desc("points"), F.asc_nulls_last("leader"))
    merged = stored(winners.select(
        "text_sha256", "chunk",
        F.first("leader").over(best).alias("all_leader"),
        F.row_number().over(best).alias("all_place"),
        F.sum("copies").over(same).alias("all_copies"),
    ), "exact-merged")
    dealt = chunked(base.join(F.broadcast(hot), "h", "left")).withColumn("prefix", F.substring("norm", 1, PREFIX))
    if carry:
        # The row brings its text, which is normalised again after the shuffle instead of moving twice.
        dealt = dealt.drop("norm").repartitionByRange("prefix", "h", "chunk").withColumn("norm", normalised(f"row.`{text_column}`"))
    else:
        dealt = dealt.repartitionByRange("prefix", "h", "chunk")
    local = ranked(dealt, *(["row"] if carry else []))
    final = local.join(F.broadcast(merged), ["text_sha256", "chunk"], "left")
    alone = F.col("all_place").isNull()
    return final.select(
        "doc_id",
        F.when(alone, F.col("leader")).otherwise(F.col("all_leader")).alias("keep_id"),
        F.coalesce("all_copies", "copies").alias("group_size"),
        (first & (alone | (F.col("all_place") == 1))).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_duplicates(docs, carry=True).where("kept").select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
"""
