"""Centroid clustering by dimension-sharded Lloyd rounds in whole numbers.

Vectors are cut twice: into chunks of rows and into shards of neighbouring dimensions.  A
block (chunk, shard) is compared with its shard's slice of the centroids only.  The exact
partial distances of a chunk's blocks are added by chunk, and their least gives the
assignment.  Assignments, not vectors, go back to the blocks; each shard sums its members
and moves its own slice.  Blocks are dealt out once and stay where they are.

No task holds a whole centroid or a whole vector.  What a round moves is the partial
distances (vectors x centroids x shards) and one number a vector and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import stored, table

CENTROIDS = 40
ROUNDS = 5
SEED = 2
WIDTH = 64
SCALE = 256
# Dimensions of a shard, and the partial distances that one chunk has at most.
SHARD_WIDTH = 32
CHUNK_CELLS = 1 << 15
# Beyond this a squared distance of 64 components might not fit 64 bits.
LARGEST = 1 << 27
# Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


def usable(vector: Column, width: int) -> Column:
    """Vectors of exactly this width without null, NaN or infinite components."""
    whole = (F.size(vector) == width) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def _blocks(chunk_rows: int, shard_width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                rows = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                ids = part.column(0).to_pylist()
                for shard, start in enumerate(range(0, rows.shape[1], shard_width)):
                    block = np.ascontiguousarray(rows[:, start:start + shard_width])
                    # Shard 0 carries the ids of the chunk.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk], pa.int64()), pa.array([shard], pa.int32()), pa.array([part.num_rows], pa.int32()),
                         pa.array([ids if shard == 0 else []], pa.list_(pa.int64())), pa.array([block.tobytes()], pa.binary())],
                        names=["chunk", "shard", "n", "ids", "block"])
                chunk += 1

    return run


def _partial(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over a shard's dimensions, exact; (vectors, centroids)."""
    most = max(int(np.abs(block).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * block.shape[1] < EXACT:
        near, far = block.astype(np.float64), centroids.astype(np.float64)
        out = (near * near).sum(axis=1)[:, None] - 2 * (near @ far.T) + (far * far).sum(axis=1)[None, :]
        return out.astype(np.int64)
    out = np.empty((len(block), len(centroids)), np.int64)
    for at, centroid in enumerate(centroids):
        out[:, at] = ((block - centroid) ** 2).sum(axis=1)
    return out


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, n, partial)`` of blocks with their slice of the centroids."""
    for batch in batches:
        for chunk, n, block, centroids, width in zip(*(batch.column(i).to_pylist() for i in range(5))):
            partial = _partial(np.frombuffer(block, np.int64).reshape(n, -1), np.array(centroids, np.int64).reshape(-1, width))
            narrow = partial.astype("<u4") if partial.max(initial=0) < 1 << 32 else partial
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([n], pa.int32()), pa.array([narrow.itemsize], pa.int32()),
                 pa.array([narrow.tobytes()], pa.binary())], names=["chunk", "n", "bytes", "partial"])


def _nearest(rows: pa.Table) -> pa.Table:
    """Add the partial distances of one chunk; ``(chunk, clusters, distances)``, ties to the smaller number."""
    total = 0
    n = rows.column("n")[0].as_py()
    for size, raw in zip(rows.column("bytes").to_pylist(), rows.column("partial").to_pylist()):
        total = total + np.frombuffer(raw, "<u4" if size == 4 else np.int64).astype(np.int64).reshape(n, -1)
    clusters = total.argmin(axis=1)
    return pa.table({
        "chunk": rows.column("chunk").slice(0, 1).combine_chunks(),
        "clusters": pa.array([clusters.astype(np.int32)], pa.list_(pa.int32())),
        "distances": pa.array([total[np.arange(n), clusters]], pa.list_(pa.int64())),
    })


def _member_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(shard, cluster, at, total, n)``: sums of the members' components, one row a task, shard, cluster and dimension."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, n, block, clusters, k in zip(*(batch.column(i).to_pylist() for i in range(5))):
            rows, own = np.frombuffer(block, np.int64).reshape(n, -1), np.array(clusters)
            if shard not in sums:
                sums[shard], counts[shard] = np.zeros((k, rows.shape[1]), np.int64), np.zeros(k, np.int64)
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            sums[shard][own[order][first]] += np.add.reduceat(rows[order], first, axis=0)
            counts[shard] += np.bincount(own, minlength=k)
    for shard, total in sums.items():
        members = np.flatnonzero(counts[shard])
        if not len(members):
            continue
        width = total.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(members) * width, shard, np.int32)), pa.array(np.repeat(members, width).astype(np.int32)),
             pa.array(np.tile(np.arange(width, dtype=np.int32), len(members))), pa.array(total[members].ravel()),
             pa.array(np.repeat(counts[shard][members], width))],
            names=["shard", "cluster", "at", "total", "n"])


def seeds(vectors: DataFrame, centroids: int, seed: int) -> DataFrame:
    """``(cluster, v)``: the vectors of the smallest hashes of their ids; equal ids go by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(centroids)
    return first.select((F.row_number().over(Window.orderBy("digest", "v")) - 1).alias("cluster"), "v")


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH,
             shard_width: int = SHARD_WIDTH, chunk_cells: int = CHUNK_CELLS, id_column: str = "vec_id",
             vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Assignments ``(vec_id, cluster, distance)`` and centroids ``(cluster, centroid)``.

    Only vectors of exactly ``width`` components, none null or non-finite, take part; each
    component x becomes floor(256 x).  Repeated rows are vectors of their own; a null id
    counts as the empty text where seeds are chosen.  With fewer vectors than centroids
    there are that many centroids; an empty table gives empty results.  Components beyond
    ``LARGEST`` end the job with an error, since their distance might not fit a long.
    Other columns don't matter.

    Centroids (``centroids x width`` numbers) are the only thing broadcast; both are arguments.
    """
    spark = vectors.sparkSession
    value = F.col(vector_column).cast("array<double>")
    whole = F.transform(F.col("x"), lambda x: F.when(
        F.abs(x * SCALE) <= LARGEST, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large"))))
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), value.alias("x")).where(
        usable(F.col("x"), width)).select("vec_id", whole.alias("v"))
    chunk_rows = max(16, chunk_cells // max(1, centroids))
    blocks = stored(kept.mapInArrow(_blocks(chunk_rows, shard_width), "chunk long, shard int, n int, ids array<long>, block binary"),
                    "cluster-blocks")
    # (cluster, shard, at, value) of every centroid component: centroids x width rows.
    current = stored(
        seeds(kept, centroids, seed).select("cluster", F.posexplode("v").alias("dim", "value")).select(
            F.col("cluster").cast("int"), (F.col("dim") / shard_width).cast("int").alias("shard"),
            (F.col("dim") % shard_width).cast("int").alias("at"), "value"),
        "cluster-centroids")
    dealt = blocks.select("chunk", "shard", "n", "block").repartition(
        _partitions(spark, blocks), "chunk", "shard").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            assigned = _assigned(dealt, current, shard_width)
            shards = F.sequence(F.lit(0), F.lit((width - 1) // shard_width))
            mine = assigned.select("chunk", "clusters", F.explode(shards).alias("shard"))
            sums = dealt.join(mine, ["chunk", "shard"]).select(
                "shard", "n", "block", "clusters", F.lit(centroids).alias("k")
            ).mapInArrow(_member_sums, "shard int, cluster int, at int, total long, n long").groupBy("shard", "cluster", "at").agg(
                F.sum("total").alias("total"), F.sum("n").alias("n"))
            floor = F.expr("(total - pmod(total, n)) div n")
            current = stored(
                current.join(sums, ["shard", "cluster", "at"], "left").select(
                    "cluster", "shard", "at", F.coalesce(floor, F.col("value")).alias("value")),
                "cluster-centroids")
        assigned = _assigned(dealt, current, shard_width)
        named = blocks.where("shard = 0").select("chunk", "ids").join(assigned, "chunk")
        rows = stored(
            named.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("r")).select(
                F.col("r.ids").alias("vec_id"), F.col("r.clusters").alias("cluster"), F.col("r.distances").alias("distance")),
            "cluster-rows")
    finally:
        dealt.unpersist()
    order = F.array_sort(F.collect_list(F.struct("shard", "at", "value")))
    return rows, current.groupBy("cluster").agg(F.transform(order, lambda c: c["value"]).alias("centroid"))


def _partitions(spark: SparkSession, blocks: DataFrame) -> int:
    """As many partitions as a shuffle has, or as the stored blocks if those are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.rdd.getNumPartitions())


def _assigned(dealt: DataFrame, current: DataFrame, shard_width: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("cluster", "at", "value")))
    slices = current.groupBy("shard").agg(
        F.transform(ordered, lambda c: c["value"]).alias("slice"), (F.max("at") + 1).alias("width"))
    return dealt.join(F.broadcast(slices), "shard").select("chunk", "n", "block", "slice", "width").mapInArrow(
        _distances, "chunk long, n int, bytes int, partial binary").groupBy("chunk").applyInArrow(
        _nearest, "chunk long, clusters array<int>, distances array<long>")


def described(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each assignment with its cluster's and the whole inertia and the digest of its centroid."""
    by_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda c: c.cast("string"))), 256)
    # One row a centroid.
    about = by_cluster.join(by_cluster.agg(F.sum("cluster_inertia").alias("inertia")).hint("broadcast"), F.lit(True)).join(
        centroids.select("cluster", digest.alias("centroid_sha256")), "cluster")
    return rows.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*clusters(table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    """The same rounds in SQL, for small tables."""
    steps = [f"""
kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v
  FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {CENTROIDS})
)"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, v, min(d) AS distance, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster
  FROM (SELECT k.row_no, k.vec_id, k.v, c.cluster,
               CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM (SELECT row_number() OVER () AS row_no, * FROM kept) k CROSS JOIN c{n} c)
  GROUP BY row_no, vec_id, v
)""")
        if n < ROUNDS:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v
  FROM c{n} c LEFT JOIN (
    SELECT cluster, list(x ORDER BY dim) AS v
    FROM (SELECT cluster, dim, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
          FROM (SELECT cluster, unnest(v) AS x, unnest(range({WIDTH})) AS dim FROM a{n}) GROUP BY cluster, dim)
    GROUP BY cluster) m USING (cluster)
)""")
    return f"""WITH {','.join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""


ORACLE = _oracle()
