"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import lasting, materialize, sql_conf

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number (null ids count as the empty text)."""
    written = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return (F.crc32(written.cast("binary")) % modulus).cast("int")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write a table to the shared scratch folder and read it back."""
    return materialize(df, label)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``stored`` for a result that outlives the ``temporary`` block around it."""
    with lasting():
        return stored(df, label)


def small_batches(spark: SparkSession) -> AbstractContextManager:
    """For a job that is run inside: tables reach Python functions in batches of a few megabytes.

    Ten thousand long texts, Spark's default, are tens of megabytes in the worker and twice
    that beside the heap of the executor.
    """
    return sql_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000")


def _give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A ``mapInArrow`` function before and after which its worker returns freed memory to the system.

    Workers serve the next jobs too, and an executor's limit counts what they hold.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``tidy`` for ``applyInArrow`` on groups: after each of them."""

    @functools.wraps(run)
    def tidied(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            _give_back()

    return tidied


def tidy_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``tidy`` for ``applyInArrow`` on cogroups: after each of them."""

    @functools.wraps(run)
    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            _give_back()

    return tidied


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have yet."""
    taken, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name
