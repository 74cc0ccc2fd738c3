"""Incremental refresh of a stored archive.

Layout under the target folder::

    archive/run=<id>/shard_name=<name>/   nested archive rows, never rewritten
    quarantine/run=<id>/                  refused records and shards
    files/run=<id>/                       one row per attachment file, classified
    derived/v=<n>/<table>-<id>/           tables derived from one manifest version
    manifest/v=<n>/                       one row per live shard: which run holds it

A run writes its rows into a folder of its own and the manifest last.  The manifest is
the commit: a reader takes the newest complete one and sees, per shard, exactly the run
that it names.  A run that dies leaves files nobody refers to, and the old state.  A
removed shard is missing from the next manifest; a shard that cannot be read keeps its
previous entry.  Attachment files are classified when they are new or have changed; a
run that finds changes writes the whole inventory, a narrow row per file, and commits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schemas as S
from colloquy.operators import attachments as A
from colloquy.operators import inventory, project
from colloquy.plans import ingest
from colloquy.plans.archive import Archive
from colloquy.session import materialize
from colloquy.sources import listing, ranges

MANIFEST = (
    "name string, byte_size bigint, modified timestamp, content_hash string, conversation_count bigint, "
    "indexed_at timestamp, projection_version string, run string, attachment_fingerprint string, "
    "files_run string"
)
FILES = (
    "name string, byte_size bigint, modified timestamp, detected_mime string, detected_extension string, "
    "preview_kind string, width bigint, height bigint"
)


def _versions(spark: SparkSession, target: str, complete: bool = True) -> list[int]:
    """Manifest versions, oldest first; the incomplete ones are those of writers that died or still write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest/v=*" + "/_SUCCESS" * complete)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = [f.getPath().getParent() if complete else f.getPath() for f in found]
    return sorted(int(f.getName()[2:]) for f in folders)


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    versions = _versions(spark, target)
    if not versions:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest/v={versions[-1]}")


def write_manifest(manifest: DataFrame, target: str) -> None:
    """Commit a new version.  Of two writers that pick the same number one fails; no commit is overwritten."""
    spark = manifest.sparkSession
    version = (_versions(spark, target, complete=False) or [0])[-1] + 1
    manifest.write.mode("errorifexists").parquet(f"{target}/manifest/v={version}")


def files_state(manifest: DataFrame) -> tuple[str, str | None]:
    """Fingerprint and run of the classified files that a manifest names; all its rows name the same."""
    row = manifest.where("files_run IS NOT NULL").select("attachment_fingerprint", "files_run").first()
    return (row.attachment_fingerprint, row.files_run) if row else ("", None)


def read_files(spark: SparkSession, target: str, run: str | None) -> DataFrame:
    """Classified attachment files, as a run stored them."""
    if run is None:
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(f"{target}/files/run={run}")


def classify_listed(spark: SparkSession, source: str, listed: DataFrame) -> DataFrame:
    """Listed attachment files with type and kind; only their prefixes are read, none of files too large to open."""
    read = ranges.prefixes(spark, source, listed, S.SIGNATURE_BYTES, S.MAX_DOWNLOAD_BYTES)
    typed = A.classify_prefixes(read).drop("byte_size").join(listed.select(*inventory.ENTRY), "name")
    columns = spark.createDataFrame([], FILES).schema
    return typed.select(*[F.col(f.name).cast(f.dataType) for f in columns])


def store_files(spark: SparkSession, source: str, listed: DataFrame, target: str, run: str, before: str | None) -> None:
    """Write the inventory of a run: what the last one has of unchanged files, and the others classified."""
    stored = read_files(spark, target, before)
    entry = list(inventory.ENTRY)
    kept = stored.join(listed.select(*entry), entry, "left_semi")
    fresh = classify_listed(spark, source, listed.join(stored.select(*entry), entry, "left_anti"))
    kept.select(*fresh.columns).unionByName(fresh).write.mode("errorifexists").parquet(f"{target}/files/run={run}")


def read_archive(spark: SparkSession, target: str) -> DataFrame:
    """Live rows: the run of each shard that the newest manifest names."""
    live = read_manifest(spark, target).select(F.col("name").alias("shard_name"), "run")
    # Naming the runs prunes the folders of dead ones.
    runs = [r.run for r in live.select("run").distinct().collect()]
    nothing = spark.createDataFrame([], "shard_name string, shard_ordinal bigint, record string")
    schema = project.project_records(nothing).schema.add("run", "string")
    # Rows without an ordinal are marks of the ingest, not records.
    rows = spark.read.schema(schema).parquet(f"{target}/archive").where(
        F.col("run").isin(runs) & F.col("shard_ordinal").isNotNull()
    )
    return rows.join(live, ["shard_name", "run"], "left_semi").drop("run")


def store_run(spark: SparkSession, listed: DataFrame, target: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Read listed shards and write the rows of one run.

    Returns the rows as written and the shards refused as a whole.
    """
    path = f"{target}/archive/run={run}"
    rows, refused = ingest.ingest_shards(spark, listed, path)
    bad = project.quarantine(rows).unionByName(refused, allowMissingColumns=True)
    bad.write.mode("overwrite").parquet(f"{target}/quarantine/run={run}")
    return rows, refused


def new_entries(read: DataFrame, hashes: DataFrame, rows: DataFrame, refused: DataFrame, run: str, state: tuple[str, str | None]
                ) -> DataFrame:
    """Manifest rows of the shards of one run; ``state`` is that of the classified files."""
    counts = rows.where(F.col("reason").isNull()).groupBy("shard_name").agg(F.count("*").alias("n"))
    return (
        read.join(hashes, "name")
        .join(refused.select(F.col("shard_name").alias("name")), "name", "left_anti")
        .join(counts.withColumnRenamed("shard_name", "name"), "name", "left")
        .select(
            "name", "byte_size", "modified", "content_hash",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("conversation_count"),
            F.current_timestamp().alias("indexed_at"),
            F.lit(S.PROJECTION_VERSION).alias("projection_version"),
            F.lit(run).alias("run"),
            F.lit(state[0]).alias("attachment_fingerprint"),
            F.lit(state[1]).cast("string").alias("files_run"),
        )
    )


def refresh(spark: SparkSession, source: str, target: str) -> dict:
    """Read new and changed shards and attachment files, drop removed ones; returns the counters of the run."""
    # Written down, not cached: the check at the end has to list the folder again, and a
    # cached plan would answer for it.
    files = materialize(listing.list_files(spark, source), "listing")
    listing.require_supported(files)
    found, attached = listing.shards_in(files), listing.attachments_in(files)
    manifest = read_manifest(spark, target)
    same = inventory.unchanged_metadata(found, manifest).select("name")
    hashes = ranges.content_hashes(spark, found.join(same, "name"))
    current = inventory.current_shards(found, manifest, hashes).cache()
    to_read = inventory.shards_to_read(found, current).select("path", *inventory.ENTRY).cache()
    n_read = to_read.count()
    run = uuid.uuid4().hex[:12]
    gone = inventory.stale_shards(manifest, found).count()
    before = files_state(manifest)
    fingerprint = inventory.fingerprint(attached).first().fingerprint
    moved = before[1] is None or before[0] != fingerprint
    state = (fingerprint, run) if moved else before
    if moved:
        store_files(spark, source, attached, target, run, before[1])
    kept = manifest.join(found.select("name"), "name", "left_semi").withColumns(
        {"attachment_fingerprint": F.lit(state[0]), "files_run": F.lit(state[1])}
    )
    n_refused = n_records = 0
    if n_read:
        rows, refused = store_run(spark, to_read, target, run)
        fresh = new_entries(to_read, ranges.content_hashes(spark, to_read), rows, refused, run, state)
        kept = kept.join(fresh.select("name"), "name", "left_anti").unionByName(fresh)
        n_refused, n_records = refused.count(), rows.count()
    if not inventory.unchanged(files, listing.list_files(spark, source)):
        raise RuntimeError("the source changed while it was read; nothing was committed")
    if n_read or gone or moved:
        write_manifest(kept, target)
    return {
        "skipped": current.count(), "read": n_read, "refused": n_refused, "records": n_records, "pruned": gone,
        "files_changed": moved,
    }


def open_archive(spark: SparkSession, source: str, target: str) -> Archive:
    """The stored archive with the attachment files of its last refresh.

    Nothing is classified again, and tables derived from this version are read where an
    earlier session has stored them.  An archive that only streams have written has no
    stored files yet; those of its source are classified then.
    """
    versions = _versions(spark, target)
    _, run = files_state(read_manifest(spark, target))
    if run is None:
        listed = listing.attachments_in(listing.list_files(spark, source))
        return Archive(read_archive(spark, target), materialize(classify_listed(spark, source, listed), "files"))
    folder = f"{target}/derived/v={versions[-1]}"
    return Archive(read_archive(spark, target), read_files(spark, target, run), folder)
