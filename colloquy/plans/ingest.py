"""Shards to stored archive rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import project
from colloquy.sources import shards


def ingest_shards(spark: SparkSession, listed: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the projected rows of listed shards below ``path``, by shard.

    Shards of every size are cut into records by the same scan.  Returns the written rows
    and the shards refused as a whole.  Of the listing only paths reach the driver, where
    the file source needs them.  The source leaves out empty shards; they aren't arrays.
    """
    paths = [r.path for r in listed.where("byte_size > 0").select("path").collect()]
    nothing = spark.createDataFrame([], "shard_name string, shard_ordinal bigint, record string")
    records, refused = shards.scan(shards.file_pieces(spark, paths)) if paths else (nothing, None)
    projected = project.project_records(records)
    projected.write.mode("overwrite").partitionBy("shard_name").parquet(path)
    rows = spark.read.schema(projected.schema).parquet(path).where(F.col("shard_ordinal").isNotNull())
    empty = listed.where("byte_size = 0").select(F.col("name").alias("shard_name"), F.lit("MALFORMED_JSON").alias("reason"))
    return rows, empty if refused is None else refused.unionByName(empty)
