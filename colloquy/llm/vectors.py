"""Near-duplicate vectors by cross-polytope hashing.

Vectors are rotated by random signs and fast Hadamard transforms; a hash is the nearest
signed axis.  A table joins ``HASHES`` of them, and each vector is also filed under its
second-best axes (multiprobe).  Vectors that share a bucket are compared in double precision.

Equal vectors are one class first.  A large bucket is compared in pairs of blocks, each
in a group of its own.  A pair counts only in the first bucket that it shares, so links
are summed where they are found and pairs never leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import stored, table
from colloquy.llm.components import connected_components

TABLES = 10
HASHES = 2
PROBES = 3
BLOCK = 1024
GROUP_ROWS = 40_000


@lru_cache(maxsize=8)
def _signs(width: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1.0, 1.0]), (hashes, 3, width))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (its length is a power of two)."""
    step, width = 1, rows.shape[1]
    while step < width:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), width)
        step *= 2
    return rows


def nearest_axes(rows: np.ndarray, tables: int) -> np.ndarray:
    """The best and the second-best signed axis of each rotation: (row, table, hash, 2)."""
    width = 1 << max(1, (rows.shape[1] - 1).bit_length())
    padded = np.zeros((len(rows), width))
    padded[:, : rows.shape[1]] = rows
    out = np.empty((len(rows), tables * HASHES, 2), np.int64)
    for which, signs in enumerate(_signs(width, tables * HASHES)):
        turned = padded
        for sign in signs:
            turned = hadamard(turned * sign)
            turned /= np.sqrt(width)
        best = np.argpartition(-np.abs(turned), 1, axis=1)[:, :2] if width > 2 else np.argsort(-np.abs(turned), axis=1)[:, :2]
        value = np.take_along_axis(turned, best, axis=1)
        order = np.argsort(-np.abs(value), axis=1, kind="stable")
        best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
        out[:, which] = 2 * best + (value < 0)
    return out.reshape(len(rows), tables, HASHES, 2)


def bucket_keys(rows: np.ndarray, labels: np.ndarray, tables: int) -> np.ndarray:
    """Keys of the buckets that each unit vector is filed under: (row, table, probe)."""
    axes = nearest_axes(rows, tables).astype(np.uint64)
    probes = [axes[:, :, :, 0]]
    for at in range(HASHES):
        other = axes[:, :, :, 0].copy()
        other[:, :, at] = axes[:, :, at, 1]
        probes.append(other)
    codes = np.stack(probes[:PROBES], axis=2)
    key = labels.view(np.uint64)[:, None, None] + np.arange(tables, dtype=np.uint64)[None, :, None] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(HASHES):
        key = (key ^ (codes[..., at] + np.uint64(rows.shape[1] << 20))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def units(vectors: list[np.ndarray]) -> np.ndarray:
    rows = np.stack(vectors).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def filed(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v.as_py(), np.float64) for v in batch.column(3)]
            sizes = np.array([len(v) for v in vectors])
            labels = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = units([vectors[i] for i in at])
                keys = bucket_keys(rows, labels[at], tables).reshape(len(at), -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)),
                     pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["rep", "label", "copies", "unit", "keys"],
                )

    return run


def _first_shared(mine: np.ndarray, other: np.ndarray, tables: int) -> np.ndarray:
    """For each pair of key lists, the first bucket that both have: table by table, then the smallest key."""
    out = np.zeros(len(mine), np.int64)
    open_ = np.arange(len(mine))
    for t in range(tables):
        part = slice(t * PROBES, (t + 1) * PROBES)
        a, b = mine[open_, part], other[open_, part]
        both = (a[:, :, None] == b[:, None, :]).any(axis=2)
        hit = both.any(axis=1)
        least = np.where(both, a, np.iinfo(np.int64).max).min(axis=1)
        out[open_[hit]] = least[hit]
        open_ = open_[~hit]
        if not len(open_):
            break
    return out


def _least_reachable(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name in each component of a symmetric matrix of links."""
    least = names
    while True:
        near = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        near = np.minimum(least, near)
        if (near == least).all():
            return least
        least = near


def compared(threshold: float, tables: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links found first in these buckets: (rep, links, root); root joins the members of a component."""
        rep, label, copies = (rows.column(n).to_numpy() for n in ("rep", "label", "copies"))
        bucket, low, high, block = (rows.column(n).to_numpy() for n in ("bucket", "low", "high", "block"))
        sizes = np.array([len(u) for u in rows.column("unit").to_pylist()])
        raw = rows.column("unit").to_pylist()
        keys = np.array(rows.column("keys").to_pylist(), np.int64).reshape(len(rep), -1)
        order = np.lexsort((rep, high, low, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(bucket[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        out_rep, out_links, out_root = [], [], []
        for at in np.split(order, np.flatnonzero(fresh)[1:]):
            if len(at) < 2:
                continue
            for size in np.unique(sizes[at]):
                own = at[sizes[at] == size]
                unit = np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), -1)
                near = (unit @ unit.T >= threshold) & (label[own][:, None] == label[own][None, :])
                np.fill_diagonal(near, False)
                if low[own[0]] != high[own[0]]:
                    near &= block[own][:, None] != block[own][None, :]
                a, b = np.nonzero(np.triu(near))
                if not len(a):
                    continue
                mine = np.zeros(len(a), bool)
                for start in range(0, len(a), 100_000):
                    part = slice(start, start + 100_000)
                    mine[part] = _first_shared(keys[own[a[part]]], keys[own[b[part]]], tables) == bucket[own[0]]
                a, b = a[mine], b[mine]
                links = np.bincount(a, copies[own[b]], len(own)) + np.bincount(b, copies[own[a]], len(own))
                found = np.flatnonzero(links)
                counted = np.zeros_like(near)
                counted[a, b] = counted[b, a] = True
                out_rep.append(rep[own[found]])
                out_links.append(links[found].astype(np.int64))
                out_root.append(_least_reachable(counted, rep[own])[found])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"rep": join(out_rep), "links": join(out_links), "root": join(out_root)})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, id_column: str = "vec_id",
                 vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per vector.

    Only vectors of equal label and length are compared.  A vector that is null, empty
    or zero, or holds a null or a non-finite component, and one without a label or an
    id, links with nothing and is its own component.  Repeated rows count as copies of
    each other.  An empty table gives an empty result; other columns don't matter.
    """
    value = F.col("v")
    usable = (
        F.col("l").isNotNull() & F.col("i").isNotNull() & value.isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_column).alias("i"), F.col(vector_column).cast("array<double>").alias("v"),
                          F.col(label_column).alias("l")).select(
        "i", "v", "l", F.coalesce(usable, F.lit(False)).alias("usable"))
    keyed = rows.withColumn("name", F.when(F.col("usable"), F.sha2(F.concat_ws(
        ",", F.lit("l"), F.col("l").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)))
    classes = stored(
        keyed.where("usable").groupBy("name").agg(
            F.min("i").alias("rep"), F.xxhash64(F.first("l")).alias("label"), F.count("*").alias("copies"), F.first("v").alias("v")),
        "vector-classes",
    )
    files = stored(
        classes.select("rep", "label", "copies", "v").mapInArrow(
            filed(tables), "rep long, label long, copies long, unit binary, keys array<long>"
        ).withColumn("file", F.monotonically_increasing_id()),
        "vector-files",
    )
    # Buckets are sized and split over numbers alone; a vector joins its blocks afterwards.
    placed = files.select("file", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = stored(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "vector-sizes")
    # A bucket of n vectors has ceil(n / BLOCK) blocks; each vector meets every block.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    total = sizes.agg(F.sum(F.col("n") * blocks)).first()[0] or 0
    groups = max(1, round(total / GROUP_ROWS))
    met = placed.join(sizes, "bucket").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("file"), F.col("blocks")).cast("int"))
    met = met.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).hint("shuffle_merge").join(files, "file").select(
        "rep", "label", "copies", "unit", "keys", "bucket", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    ).withColumn("group", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(groups)))
    links = stored(
        met.groupBy("group").applyInArrow(compared(threshold, tables), "rep long, links long, root long"), "vector-links"
    )
    joined = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("name", "rep", "copies").join(counts, "rep", "left").join(
        joined.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
             F.coalesce("component", "rep").alias("component_id"))
    return keyed.select("i", "name").join(stored(known, "vector-known"), "name", "left").select(
        F.col("i").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("i")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", F.col("i")) == F.col("i"), F.lit(True)).alias("kept"),
    )


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
