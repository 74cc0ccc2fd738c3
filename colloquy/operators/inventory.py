"""Comparing inventories: what is current, what is stale, what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import schemas as S

ENTRY = ("name", "byte_size", "modified")


def current_shards(listing: DataFrame, manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """Names of listed shards that need no new read.

    The manifest entry must have this projection version, the same size and time, and a
    hash that the content still has.  ``hashes`` is ``(name, content_hash)``; only the
    rows of ``unchanged_metadata`` are needed.
    """
    same = unchanged_metadata(listing, manifest)
    return same.join(hashes.withColumnRenamed("content_hash", "hash_now"), "name").where(
        F.col("hash_now") == F.col("content_hash")
    ).select("name")


def unchanged_metadata(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(name, content_hash)`` where size, time and version agree with the manifest."""
    stored = manifest.where(
        (F.col("projection_version") == S.PROJECTION_VERSION) & (F.col("content_hash") != "")
    ).select(*ENTRY, "content_hash")
    return listing.select(*ENTRY).join(stored, list(ENTRY)).select("name", "content_hash")


def shards_to_read(listing: DataFrame, current: DataFrame) -> DataFrame:
    return listing.join(current, "name", "left_anti")


def stale_shards(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored shards that are not in the source any more."""
    return manifest.select("name").join(listing.select("name"), "name", "left_anti")


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a file inventory, independent of row order.

    The digests of the entries are combined with exclusive or, chunk by chunk, which
    needs no sort and combines before the shuffle; names are unique, so entries cannot
    cancel out.
    """
    entry = F.concat_ws("\x1f", "name", F.col("byte_size").cast("string"), F.unix_micros("modified").cast("string"))
    digest = files.select(F.sha2(entry, 256).alias("h"))
    chunks = [F.bit_xor(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("bigint")) for i in range(4)]
    hexed = [F.lpad(F.lower(F.hex(F.coalesce(c, F.lit(0).cast("bigint")))), 15, "0") for c in chunks]
    return digest.agg(F.count("*").alias("files"), F.concat(*hexed).alias("fingerprint"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries that appear in one snapshot only, with their side."""
    old, new = before.select(*ENTRY), after.select(*ENTRY)
    return old.exceptAll(new).withColumn("side", F.lit("before")).unionByName(
        new.exceptAll(old).withColumn("side", F.lit("after"))
    )


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    return snapshot_changes(before, after).isEmpty()
