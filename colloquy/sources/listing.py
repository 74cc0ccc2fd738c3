"""What lies in an export folder.  Listings read file metadata only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import ascii_lower


def is_shard_name(name: Column) -> Column:
    return name.rlike(r"^conversations(?:-[0-9]+)?\.json\z")


def is_attachment_name(name: Column) -> Column:
    return ascii_lower(name).rlike(r"^file[-_].*\.dat\z")


def shard_order(name: Column) -> Column:
    """Sort key: the unnumbered shard, then by number, then by name."""
    digits = F.regexp_extract(name, r"^conversations-([0-9]+)\.json\z", 1)
    # Numbers beyond 64 bits sort last, as the largest number would.
    number = F.try_to_number(digits, F.lit("9" * 20))
    capped = F.when(number <= 2**63 - 2, number.cast("bigint")).otherwise(F.lit(2**63 - 2))
    rank = F.when(digits == "", F.lit(0).cast("bigint")).otherwise(capped + 1)
    return F.struct(rank.alias("rank"), name.alias("name"))


def qualified(spark: SparkSession, root: str) -> str:
    """The folder as the file sources spell it in their paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """Files directly in a folder, with their name; content is read only if selected.

    The folder is listed once, as a whole: a glob would be listed path by path.
    """
    prefix = qualified(spark, root) + "/"
    files = spark.read.format("binaryFile").load(root)
    return files.where(
        F.col("path").startswith(prefix) & ~F.substring("path", len(prefix) + 1, 2**30).contains("/")
    ).withColumn("name", F.substring("path", len(prefix) + 1, 2**30))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, name, byte_size, modified)`` of the files directly in a folder.

    The file sources leave out empty files when they read, but have listed them; those
    are taken from there, without a time.  The names stay in the JVM, where the listing is.
    """
    found = binary_files(spark, root).select(
        "path", "name", F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified")
    )
    jvm = spark._jvm
    listed = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(spark.read.format("binaryFile").load(root)._jdf.inputFiles())
    uris = DataFrame(spark._jsparkSession.createDataset(listed, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    prefix = qualified(spark, root) + "/"
    name = F.substring("path", len(prefix) + 1, 2**30)
    # A path writes an empty authority without its slashes.
    plain = F.regexp_replace(unescaped(F.col("value")), "^([^:/]+):///", "$1:/")
    every = uris.select(plain.alias("path")).where(
        F.col("path").startswith(prefix) & ~name.contains("/")
    )
    empty = every.join(found.select("path"), "path", "left_anti").select(
        "path", name.alias("name"), F.lit(0).cast("bigint").alias("byte_size"), F.lit(None).cast("timestamp").alias("modified")
    )
    return found.unionByName(empty)


def unescaped(uri: Column) -> Column:
    """An address as the path it stands for; a plus sign is itself there."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def shards_in(files: DataFrame) -> DataFrame:
    return files.where(is_shard_name(F.col("name")))


def attachments_in(files: DataFrame) -> DataFrame:
    return files.where(is_attachment_name(F.col("name")))


def validation(files: DataFrame, max_shards: int | None = None, max_attachments: int | None = None,
               max_json_bytes: int | None = None) -> DataFrame:
    """Counts and sizes of an export, and whether it has shards and is within the limits that the caller sets."""
    shard, attached = is_shard_name(F.col("name")), is_attachment_name(F.col("name"))
    counts = files.agg(
        F.count_if(shard).alias("shard_count"),
        F.count_if(attached).alias("attachment_file_count"),
        F.coalesce(F.sum(F.when(shard, F.col("byte_size"))), F.lit(0)).cast("bigint").alias("total_json_bytes"),
    )
    supported = F.col("shard_count") >= 1
    limits = {"shard_count": max_shards, "attachment_file_count": max_attachments, "total_json_bytes": max_json_bytes}
    for name, limit in limits.items():
        if limit is not None:
            supported = supported & (F.col(name) <= limit)
    return counts.withColumn("supported", supported)


def require_supported(files: DataFrame) -> None:
    row = validation(files).first()
    if not row.supported:
        raise ValueError(f"not a supported export: {row.asDict()}")
