"""Session helpers: settings that matter at scale, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # Checkpoint files of rounds that are no longer referenced go away by themselves.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session
    without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="colloquy-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that computes its input once.

    A bare ``checkpoint()`` runs the plan twice (once for the count, once for the
    files), so the rows are held on executors until the files are written.  A lost
    executor only costs the recomputation of its part.
    """
    scratch_root(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a costly narrow job over an input of few partitions.

    A large input has more partitions than the cluster has cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write an intermediate table to the scratch folder and read it back.

    Its shuffle files go as soon as it is written, since nothing reads them again.
    """
    path = scratch_path(df.sparkSession, label)
    write_table(df, path, partition_by)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    if _scratch.get():
        _scratch.get()[-1].append(path)
    return written


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table whose shuffle files nothing reads again; they go with the job."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with sql_conf(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        writer.parquet(path)


def complete_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern and whose writer has committed, by name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(f.getPath().getParent().toString() for f in found)


# Paths of the open ``temporary`` blocks, innermost last.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def temporary(spark: SparkSession):
    """Tables written inside are deleted at the end, on failure too.

    What is read later has to be written inside ``lasting()``.
    """
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def lasting():
    """Tables written inside outlive the innermost ``temporary`` block; an outer one still deletes them."""
    token = _scratch.set(_scratch.get()[:-1])
    try:
        yield
    finally:
        _scratch.reset(token)


def fixed_splits(spark: SparkSession, split_bytes: int | None = None) -> SparkSession:
    """A session with the settings of this one whose file splits depend on no later change of settings or cluster size."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if split_bytes is not None:
        own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own


@contextmanager
def sql_conf(spark: SparkSession, **settings: str):
    """Set SQL settings (dots written as ``__``) for the plans made inside."""
    before = {}
    for name, value in settings.items():
        key = name.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
