import hashlib
import random

import duckdb
import pytest

from colloquy.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, v int, chunk string, n int"


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows, partitions=4):
        full = [(i, v, 0, 1, 2, "x", 3) for i, v in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


def lloyd(rows, k, rounds, seed, width):
    """The definition, one vector at a time: (vec_id, cluster, distance) and centroids."""
    import math

    import numpy as np

    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:k]]
    for last in [False] * rounds + [True]:
        near = []
        for _, v in kept:
            near.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)))
        if not last:
            for n in range(len(centers)):
                members = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                if members:
                    centers[n] = [sum(x) // len(members) for x in zip(*members)]
    return sorted((str(i), n, d) for (i, _), (d, n) in zip(kept, near)), centers


def vectors(rng, n, width):
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("width, shard_width", [(6, 2), (7, 3), (5, 8)])
def test_rounds_follow_the_definition(frame, width, shard_width):
    rng = random.Random(width)
    rows = vectors(rng, 150, width)
    rows += [(500 + i, list(rows[3][1])) for i in range(60)]  # one frequent vector
    rows += [(7, list(rows[8][1])), (7, list(rows[8][1])), (None, list(rows[9][1]))]
    rows += [(900, None), (901, []), (902, [1.0] * (width + 1)), (903, [float("nan")] + [0.0] * (width - 1)),
             (904, [float("inf")] + [0.0] * (width - 1)), (905, [None] + [0.0] * (width - 1)), (906, [0.0] * width)]
    got, centers = centroids.clusters(frame(rows), 9, 4, 2, width, shard_width, chunk_cells=9 * 16)
    want, want_centers = lloyd(rows, 9, 4, 2, width)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert [r.centroid for r in sorted(centers.collect())] == want_centers
    about = centroids.described(got, centers).collect()
    assert len(about) == len(want)
    for r in about:
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster) and r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centers[r.cluster])).encode()).hexdigest()


def test_few_vectors_ties_and_empty_tables(frame):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])]
    got, centers = centroids.clusters(frame(rows), 40, 2, 2, 2, 1)
    want, want_centers = lloyd(rows, 40, 2, 2, 2)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert [r.centroid for r in sorted(centers.collect())] == want_centers
    got, centers = centroids.clusters(frame([(1, None)]), 3, 2, 2, 2, 1)
    assert centroids.described(got, centers).collect() == [] and centers.collect() == []


def test_large_components(frame):
    rows = [(i, [1000.0 * i, -300_000.5, 0.25]) for i in range(20)]
    got, _ = centroids.clusters(frame(rows), 3, 2, 2, 3, 2)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == lloyd(rows, 3, 2, 2, 3)[0]
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(frame([(1, [1e9, 0.0])]), 1, 1, 2, 2, 2)


def test_query_equals_its_sql(spark, frame, tmp_path):
    rng = random.Random(5)
    rows = vectors(rng, 200, 64) + [(300, [0.5] * 63), (301, None), (302, [float("nan")] * 64)]
    frame(rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = centroids.op12_centroids(spark, str(tmp_path))
    want = duck.execute(centroids.ORACLE)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_blocks_stay_where_they_are(spark, frame):
    """A round shuffles partial distances, assignments and sums; no block."""
    rng = random.Random(6)
    seen = []
    real = centroids._assigned

    def watch(dealt, current, shard_width):
        out = real(dealt, current, shard_width)
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    centroids._assigned = watch
    try:
        centroids.clusters(frame(vectors(rng, 40, 4)), 3, 1, 2, 4, 2)[0].count()
    finally:
        centroids._assigned = real
    exchanges = [line for line in seen[-1].split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("block" in line for line in exchanges)
