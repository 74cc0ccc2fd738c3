"""Parts of files: prefixes, and hashes of files of any size.

No file is ever one value, so neither its size nor the memory of a task bounds it.

* ``prefixes`` deals out a listing; a task opens each of its files and reads the first
  bytes only.  Where the store has no client outside Spark, the file source reads whole
  files instead, whose size it bounds by ``spark.sql.sources.binaryFile.maxLength``.
* ``content_hashes`` reads files by splits of a fixed size with Spark's own reader.  A
  split gives one digest, and digests are hashed upwards as a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from colloquy.session import fixed_splits, spread
from colloquy.sources import listing

# Hashes that are stored depend on them.
HASH_SPLIT_BYTES = 32 << 20
HASH_FAN_OUT = 1024

# Prefixes leave a task in batches of so many rows.
PREFIX_ROWS = 64


# ------------------------------------------------------------------------ prefixes


@lru_cache(maxsize=64)
def _store(scheme: str, authority: str) -> tuple[pafs.FileSystem, str]:
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), ""
    known = "s3" if scheme in ("s3a", "s3n") else scheme
    store, base = pafs.FileSystem.from_uri(f"{known}://{authority}/")
    return store, base.rstrip("/")


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path as the file sources spell it (nothing is escaped there), and the path inside."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "", path
    authority = ""
    if rest.startswith("//"):
        authority, _, rest = rest[2:].partition("/")
        rest = "/" + rest
    store, base = _store(scheme, authority)
    return store, base + rest


def reachable(root: str) -> bool:
    """Whether a folder's store has a client outside Spark."""
    try:
        store, inside = _place(root)
        return store.get_file_info(inside).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException):  # no such client, or one that lacks its libraries
        return False


def read_range(path: str, offset: int, size: int) -> bytes:
    """Up to ``size`` bytes from ``offset`` on."""
    store, inside = _place(path)
    with store.open_input_file(inside) as file:
        return file.read_at(size, offset)


def prefixes(spark: SparkSession, root: str, files: DataFrame, size: int, limit: int) -> DataFrame:
    """Listed files of a folder with the column ``prefix``: their first ``size`` bytes.

    ``files`` has ``path`` and ``byte_size``, among others.  Files of over ``limit`` bytes
    aren't opened; their prefix is null.
    """
    asked = F.col("byte_size") <= limit
    if not reachable(listing.qualified(spark, root)):
        # The filter on the length reaches the source, which doesn't open what it leaves out.
        found = spark.read.format("binaryFile").load(root).where(F.col("length") <= limit)
        read = files.join(found.select("path", F.substring("content", 1, size).alias("prefix")), "path", "left")
        # Nor does the source read empty files.
        return read.withColumn("prefix", F.when(F.col("byte_size") == 0, F.lit(b"")).otherwise(F.col("prefix")))
    schema = StructType(files.schema.fields).add("prefix", BinaryType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PREFIX_ROWS):
                rows = batch.slice(start, PREFIX_ROWS)
                found = [
                    read_range(path, 0, min(size, n)) if wanted else None
                    for path, n, wanted in zip(*(rows.column(c).to_pylist() for c in ("path", "byte_size", "_asked")))
                ]
                columns = [rows.column(c) for c in rows.schema.names if c != "_asked"]
                names = [c for c in rows.schema.names if c != "_asked"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=[*names, "prefix"])

    return spread(files).withColumn("_asked", asked).mapInArrow(read, schema)


# -------------------------------------------------------------------------- hashes


def _split_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split; its rows come together and in order."""
    names, blocks, digests = [], [], []
    digest = None
    for batch in batches:
        for name, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if digest is None or (name, block) != (names[-1], blocks[-1]):
                if digest is not None:
                    digests.append(digest.hexdigest())
                digest = hashlib.sha256()
                names.append(name)
                blocks.append(block)
            digest.update(piece)
            digest.update(b"}")
    if digest is not None:
        digests.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(blocks, pa.int64()), pa.array(digests, pa.string())],
        names=["name", "block", "digest"])


def _level(rows: DataFrame, *keys: str) -> DataFrame:
    """The digests of each group, in order, hashed together; ``block`` is that of the first."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "digest")))
    joined = F.array_join(F.transform(ordered, lambda d: d["digest"]), "")
    return rows.groupBy(*keys).agg(F.min("block").alias("block"), F.sha2(joined, 256).alias("digest"))


def content_hashes(spark: SparkSession, files: DataFrame, split_bytes: int = HASH_SPLIT_BYTES) -> DataFrame:
    """``(name, content_hash)`` of listed files ``(path, name, byte_size)``, read by splits.

    Splits lie at multiples of ``split_bytes`` whatever else is read with them, so a hash
    depends on the file alone.  The reader cuts at closing braces: a split has the pieces
    that start in it.  It can't tell whether the last piece of a file has its brace, so the
    size is hashed too.  A group of the tree has ``HASH_FAN_OUT`` digests at most below the
    root, and the root one for every 32 GiB.  Of the listing only paths reach the driver,
    where the file source needs them.
    """
    paths = [r.path for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "name string, content_hash string")
    own = fixed_splits(spark, split_bytes)
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.unset("spark.sql.files.maxPartitionNum")
    read = own.read.text(paths, lineSep="}").select(
        listing.unescaped(F.col("_metadata.file_name")).alias("name"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"))
    splits = read.mapInArrow(_split_digests, "name string, block bigint, digest string")
    part = F.expr(f"block div {split_bytes * HASH_FAN_OUT}")
    root = _level(_level(splits.withColumn("part", part), "name", "part"), "name")
    sized = files.select("name", "byte_size").join(root, "name", "left")
    whole = F.concat_ws(":", F.col("byte_size").cast("string"), F.coalesce("digest", F.lit("")))
    return sized.select("name", F.sha2(whole, 256).alias("content_hash"))
