"""Connected components by alternating star contraction, without hubs in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import kept, stored
from colloquy.session import temporary


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "parent") % (1 << 31)).alias("h")).first()
    return row.n, row.h or 0


def _with_minimum(links: DataFrame) -> DataFrame:
    """Add to each link (node, other) the least neighbour of its node.

    The minima are a table of their own, so that adaptive execution can split the
    links of a hub when the two are joined.
    """
    least = stored(links.groupBy("node").agg(F.min("other").alias("least")), "cc-least")
    return links.join(least, "node")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(a, b)``.

    The component is the smallest node that can be reached.  Rows with a null end or
    with equal ends link nothing.  Large-star and small-star rounds alternate until
    the parent table is a forest of stars; rounds grow with the logarithm of the
    component size.  Each round ends in a written table; only the last one stays.
    """
    with temporary(edges.sparkSession):
        return kept(_contracted(edges, max_rounds), "cc-components")


def _contracted(edges: DataFrame, max_rounds: int) -> DataFrame:
    parents = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
        .distinct(),
        "cc-edges",
    )
    state = _state(parents)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = parents.select("node", F.col("parent").alias("other")).union(
            parents.select(F.col("parent").alias("node"), F.col("node").alias("other"))
        )
        large = (
            _with_minimum(both)
            .where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("node"), F.least("least", "node").alias("other"))
            .distinct()
        )
        large = stored(large, "cc-large")
        linked = _with_minimum(large)
        small = (
            linked.select("node", F.col("least").alias("parent"))
            .union(linked.where("other > least").select(F.col("other").alias("node"), F.col("least").alias("parent")))
            .distinct()
        )
        parents = stored(small, "cc-small")
        before, state = state, _state(parents)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = parents.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return parents.select("node", F.col("parent").alias("component")).union(roots)
