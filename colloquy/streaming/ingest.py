"""File-stream ingest: new shards are read as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.plans import refresh
from colloquy.sources import listing, ranges

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def shard_stream(spark: SparkSession, source: str, files_per_batch: int = 100) -> DataFrame:
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "conversations*.json")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
    )
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"),
        F.col("length").alias("byte_size"),
        F.col("modificationTime").alias("modified"),
    ).where(listing.is_shard_name(F.col("name")))


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the engine gave to the query of this checkpoint folder."""
    row = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()
    return row.id.replace("-", "")


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start an ingest of the shards present now; it ends when they are done.

    A batch writes the run named after the query's id and itself, so a repeated batch
    overwrites its own folder and the manifest entry it writes is the same.  The id is new
    for every checkpoint folder, so no other stream writes there.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        listed = batch.cache()
        try:
            if listed.isEmpty():
                return
            run = f"stream-{query_id(session, checkpoint)}-{batch_id}"
            rows, refused = refresh.store_run(session, listed, target, run)
            manifest = refresh.read_manifest(session, target)
            fresh = refresh.new_entries(
                listed, ranges.content_hashes(session, listed), rows, refused, run, refresh.files_state(manifest)
            )
            refresh.write_manifest(
                manifest.join(fresh.select("name"), "name", "left_anti").unionByName(fresh), target
            )
        finally:
            listed.unpersist()

    return (
        shard_stream(spark, source)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
