"""Message trees: active path, terminal leaf of each branch, subtrees, all paths, branch lists.

Parents are followed by pointer doubling: after round k a node knows its 2^k-th
ancestor, so a chain of length L takes about log2(L) rounds instead of L.  Only the
skeleton of the tree (keys, times) takes part; message text never does.  All edges
stay inside one conversation, so the skeleton is partitioned once by conversation
and each round joins it with itself in place.  Each round is cut off with a reliable
checkpoint, so a lost executor does not replay the whole loop.

Subtrees are intervals: nodes are numbered along an Euler tour, whose places are found by
ranking the list of its steps, again by doubling.  What lies below a node is then a range
of numbers, so the descendant closure takes one row a node, not one a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import schemas as S
from colloquy.operators.project import node_rows, renderable
from colloquy.session import checkpoint, sql_conf

# With these, a join on (conversation, node) reuses the partitioning by conversation.
# Partitions are even here, so the adaptive planner has nothing to repair.
CO_PARTITIONED = {
    "spark__sql__requireAllClusterKeysForCoPartition": "false",
    "spark__sql__adaptive__enabled": "false",
}


def skeleton(archive: DataFrame) -> DataFrame:
    """Keys and times of every node, partitioned by conversation."""
    spark = archive.sparkSession
    rows = node_rows(
        archive, "node_id", "parent_node_id", "created_at", keep=("conversation_key", "current_node", "n_nodes")
    )
    flat = rows.withColumn("is_current", F.col("node_id") == F.col("current_node")).drop("current_node")
    return flat.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conversation_key")


def _start(bones: DataFrame) -> DataFrame:
    """First round: is the parent there, does the node have children."""
    key = "conversation_key"
    here = bones.select(key, F.col("node_id").alias("parent_node_id"), F.lit(True).alias("parent_found"))
    parents = (
        bones.where(F.col("parent_node_id").isNotNull())
        .select(key, F.col("parent_node_id").alias("node_id"))
        .distinct()
        .withColumn("has_children", F.lit(True))
    )
    rows = bones.join(here, [key, "parent_node_id"], "left").join(parents, [key, "node_id"], "left")
    found = F.col("parent_found").isNotNull()
    leaf = F.struct(F.coalesce("created_at", F.lit(0.0)).alias("at"), F.col("node_id").alias("leaf"))
    return rows.select(
        key,
        "node_id",
        F.when(found, F.col("parent_node_id")).alias("jump"),
        F.when(F.col("has_children").isNull(), leaf).alias("best"),
        F.when(F.col("is_current"), F.lit(0).cast("bigint")).alias("dist"),
        "n_nodes",
        (F.col("parent_node_id").isNotNull() & ~found).alias("dangling"),
        F.lit(False).alias("cyclic"),
    )


def _double(state: DataFrame, span: int) -> DataFrame:
    """One round: pass results 2^k steps up, then jump twice as far."""
    key = "conversation_key"
    up = (
        state.where(F.col("jump").isNotNull())
        .groupBy(key, F.col("jump").alias("node_id"))
        .agg(F.max("best").alias("best_below"), F.min(F.col("dist") + span).alias("dist_below"))
    )
    hop = state.select(key, F.col("node_id").alias("jump"), F.col("jump").alias("next_jump"))
    joined = state.join(up, [key, "node_id"], "left").join(hop, [key, "jump"], "left")
    # A chain without a cycle has fewer than n_nodes ancestors.
    endless = F.col("next_jump").isNotNull() & (F.lit(2 * span) >= F.col("n_nodes"))
    return joined.select(
        key,
        "node_id",
        F.when(~endless, F.col("next_jump")).alias("jump"),
        F.greatest("best", "best_below").alias("best"),
        F.least("dist", "dist_below").alias("dist"),
        "n_nodes",
        "dangling",
        (F.col("cyclic") | F.coalesce(endless, F.lit(False))).alias("cyclic"),
    )


def link_nodes(archive: DataFrame) -> DataFrame:
    """Per node: terminal leaf below it, position on the active path, cycle flags.

    ``position`` counts from the root and is null off the path, and for every node
    of a path that does not end at a root (cycle or dangling reference).
    """
    spark = archive.sparkSession
    key = "conversation_key"
    with sql_conf(spark, **CO_PARTITIONED):
        state = checkpoint(_start(checkpoint(skeleton(archive))))
        span = 1
        while not state.where(F.col("jump").isNotNull()).isEmpty():
            state = checkpoint(_double(state, span))
            span *= 2
        paths = state.where(F.col("dist").isNotNull()).groupBy(key).agg(
            F.max("dist").alias("last"),
            F.bool_or("cyclic").alias("path_cyclic"),
            F.bool_or("dangling").alias("path_dangling"),
        )
        linked = state.join(paths, key, "left")
        whole = F.col("dist").isNotNull() & ~F.col("path_cyclic") & ~F.col("path_dangling")
        return checkpoint(
            linked.select(
                key,
                "node_id",
                F.col("best.leaf").alias("terminal_leaf"),
                "dist",
                F.when(whole, F.col("last") - F.col("dist")).alias("position"),
                "cyclic",
                "dangling",
            )
        )


def path_status(archive: DataFrame, links: DataFrame) -> DataFrame:
    """OK, CYCLE, MISSING or EMPTY for the active path of each conversation."""
    flags = links.where(F.col("dist").isNotNull()).groupBy("conversation_key").agg(
        F.bool_or("cyclic").alias("cyclic"),
        F.bool_or("dangling").alias("dangling"),
        F.count("*").alias("nodes_seen"),
    )
    status = (
        F.when(F.col("current_node").isNull(), "EMPTY")
        .when(F.col("nodes_seen").isNull() | F.col("dangling"), "MISSING")
        .when(F.col("cyclic"), "CYCLE")
        .otherwise("OK")
    )
    headers = archive.where(F.col("reason").isNull()).select("conversation_key", "current_node")
    return headers.join(flags, "conversation_key", "left").select(
        "conversation_key", status.alias("status"), F.coalesce("nodes_seen", F.lit(0).cast("bigint")).alias("path_nodes")
    )


def cycle_diagnostics(archive: DataFrame, links: DataFrame) -> DataFrame:
    return path_status(archive, links).where("status = 'CYCLE'").select(
        "conversation_key",
        F.lit("ACTIVE_PATH_CYCLE").alias("code"),
        F.lit(1).cast("bigint").alias("occurrence_count"),
    )


def _tour(archive: DataFrame, links: DataFrame) -> DataFrame:
    """Steps ``(conversation_key, step, next, places)`` of the Euler tour of every conversation.

    A node is entered (``+``, which takes a place) and left (``-``).  Siblings follow each
    other by time and id, roots like siblings.  Nodes on or below a cycle take no part; a
    node whose parent is missing is a root.
    """
    key = "conversation_key"
    sound = links.where(~F.col("cyclic")).select(key, "node_id")
    bones = skeleton(archive).join(sound, [key, "node_id"], "left_semi").select(
        key, "node_id", "parent_node_id", F.struct(F.coalesce("created_at", F.lit(0.0)).alias("at"), F.col("node_id").alias("id")).alias("place"))
    there = bones.select(key, F.col("node_id").alias("parent_node_id"), F.lit(True).alias("found"))
    rooted = checkpoint(bones.join(there, [key, "parent_node_id"], "left").select(
        key, "node_id", F.when(F.col("found"), F.col("parent_node_id")).alias("parent"), "place"))
    first = rooted.where(F.col("parent").isNotNull()).groupBy(key, F.col("parent").alias("node_id")).agg(
        F.min("place")["id"].alias("first_child"))
    order = Window.partitionBy(key, "parent").orderBy("place")
    around = rooted.withColumn("next_sibling", F.lead("node_id").over(order)).join(first, [key, "node_id"], "left")

    def enter(c: str):
        return F.concat(F.lit("+"), c)

    def leave(c: str):
        return F.concat(F.lit("-"), c)

    steps = F.array(
        F.struct(enter("node_id").alias("step"), F.coalesce(enter("first_child"), leave("node_id")).alias("next"),
                 F.lit(1).cast("bigint").alias("places")),
        F.struct(leave("node_id").alias("step"), F.coalesce(enter("next_sibling"), leave("parent")).alias("next"),
                 F.lit(0).cast("bigint").alias("places")),
    )
    return around.select(key, F.explode(steps).alias("s")).select(key, "s.step", "s.next", "s.places")


def _rank(state: DataFrame) -> DataFrame:
    """One round of list ranking: add what the next stretch holds, then reach twice as far."""
    key = "conversation_key"
    ahead = state.select(key, F.col("step").alias("next"), F.col("next").alias("after"), F.col("places").alias("more"))
    return state.join(ahead, [key, "next"], "left").select(
        key, "step", F.col("after").alias("next"), (F.col("places") + F.coalesce("more", F.lit(0))).alias("places"))


def tree_intervals(archive: DataFrame, links: DataFrame) -> DataFrame:
    """``(conversation_key, node_id, pre, last_pre, n_descendants)``, one row a node outside cycles.

    ``pre`` numbers the nodes of a conversation from zero, parents before children; the
    descendants of a node are those numbered ``pre + 1`` to ``last_pre``.
    """
    key = "conversation_key"
    with sql_conf(archive.sparkSession, **CO_PARTITIONED):
        state = checkpoint(_tour(archive, links))
        while not state.where(F.col("next").isNotNull()).isEmpty():
            state = checkpoint(_rank(state))
        entered = F.substring("step", 1, 1) == "+"
        places = state.groupBy(key, F.expr("substring(step, 2)").alias("node_id")).agg(
            F.max(F.when(entered, F.col("places"))).alias("enter"), F.max(F.when(~entered, F.col("places"))).alias("leave"))
        whole = state.groupBy(key).agg(F.max("places").alias("whole"))
        pre = F.col("whole") - F.col("enter")
        size = F.col("enter") - F.col("leave")
        return checkpoint(places.join(whole, key).select(
            key, "node_id", pre.alias("pre"), (pre + size - 1).alias("last_pre"), (size - 1).alias("n_descendants")))


def descendants(intervals: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(conversation_key, node_id, descendant_id)`` of the given nodes ``(conversation_key, node_id)``: one range a node."""
    key = "conversation_key"
    asked = intervals.join(nodes.select(key, "node_id").distinct(), [key, "node_id"], "left_semi").select(
        key, "node_id", F.col("pre").alias("low"), F.col("last_pre").alias("high"))
    below = intervals.select(key, F.col("node_id").alias("descendant_id"), "pre")
    return asked.join(below, key).where("pre > low AND pre <= high").select(key, "node_id", "descendant_id")


def ancestors(intervals: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(conversation_key, node_id, position, ancestor_id)``: the path of each given node, itself included, from its root."""
    key = "conversation_key"
    asked = intervals.join(nodes.select(key, "node_id").distinct(), [key, "node_id"], "left_semi").select(
        key, "node_id", F.col("pre").alias("at"))
    above = intervals.select(key, F.col("node_id").alias("ancestor_id"), "pre", "last_pre")
    found = asked.join(above, key).where("at >= pre AND at <= last_pre")
    order = Window.partitionBy(key, "node_id").orderBy("pre")
    return found.select(key, "node_id", (F.row_number().over(order) - 1).cast("bigint").alias("position"), "ancestor_id")


def all_paths(archive: DataFrame, links: DataFrame) -> DataFrame:
    """The path of every leaf: ``(conversation_key, leaf_node_id, position, node_id)``.

    This is the batch form of switching branches.  Reach doubles with the jumps, so
    the work is proportional to the rows returned.
    """
    spark = archive.sparkSession
    key = "conversation_key"
    with sql_conf(spark, **CO_PARTITIONED):
        sound = links.where(~F.col("cyclic")).select(key, "node_id", "terminal_leaf")
        bones = checkpoint(
            skeleton(archive)
            .select(key, "node_id", F.col("parent_node_id").alias("jump"))
            .join(sound.select(key, F.col("node_id").alias("jump"), F.lit(True).alias("ok")), [key, "jump"], "left")
            .select(key, "node_id", F.when(F.col("ok"), F.col("jump")).alias("jump"))
        )
        leaves = sound.where(F.col("node_id") == F.col("terminal_leaf"))
        reach = leaves.select(
            key, F.col("node_id").alias("leaf_node_id"), "node_id", F.lit(0).cast("bigint").alias("dist")
        )
        jumps, span = bones, 1
        while not jumps.where(F.col("jump").isNotNull()).isEmpty():
            steps = jumps.where(F.col("jump").isNotNull())
            further = reach.join(steps, [key, "node_id"]).select(
                key, "leaf_node_id", F.col("jump").alias("node_id"), (F.col("dist") + span).alias("dist")
            )
            reach = checkpoint(reach.unionByName(further))
            hop = jumps.select(key, F.col("node_id").alias("jump"), F.col("jump").alias("next_jump"))
            jumps = checkpoint(
                jumps.join(hop, [key, "jump"], "left").select(key, "node_id", F.col("next_jump").alias("jump"))
            )
            span *= 2
        last = reach.groupBy(key, "leaf_node_id").agg(F.max("dist").alias("last"))
        return reach.join(last, [key, "leaf_node_id"]).select(
            key, "leaf_node_id", (F.col("last") - F.col("dist")).alias("position"), "node_id"
        )


def branch_lists(archive: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """Alternate branches of each active-path node, in order.

    With a limit the first children by time count; the active child is removed after that.
    """
    key = "conversation_key"
    on_path = links.where(F.col("position").isNotNull()).select(
        key, F.col("node_id").alias("parent_node_id"), F.col("position").alias("parent_position")
    )
    children = node_rows(
        archive, "node_id", "parent_node_id", "role", "created_at", "message_text"
    ).select(
        key, "node_id", "parent_node_id", "role", "created_at",
        F.left("message_text", F.lit(S.BRANCH_PREVIEW_CHARS)).alias("preview"),
    )
    order = Window.partitionBy(key, "parent_node_id").orderBy(
        F.coalesce("created_at", F.lit(0.0)), "node_id"
    )
    ranked = (
        children.where(F.col("parent_node_id").isNotNull())
        .join(on_path, [key, "parent_node_id"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.lit(True) if limit is None else F.col("rank") <= limit)
    )
    own = links.select(key, "node_id", "terminal_leaf", "position")
    active = F.coalesce(F.col("position") == F.col("parent_position") + 1, F.lit(False))
    return (
        ranked.join(own, [key, "node_id"])
        .where(~active)
        .select(
            key,
            "parent_node_id",
            F.col("rank").cast("bigint").alias("branch_rank"),
            F.col("terminal_leaf").alias("leaf_node_id"),
            "role",
            "preview",
        )
    )


def active_path(archive: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes of the active path with their text, by position from the root."""
    key = "conversation_key"
    path = links.where(F.col("position").isNotNull()).select(key, "node_id", "position")
    rows = node_rows(
        archive, "node_id", "message_id", "role", "created_at", "content_type", "message_text"
    )
    return rows.join(path, [key, "node_id"])


def conversation_detail(archive: DataFrame, links: DataFrame, attachments: DataFrame) -> DataFrame:
    """One nested row per conversation: header, shown messages, files, branches.

    Every conversation at once; a filter on ``conversation_key`` reaches the scans.
    """
    key = "conversation_key"
    branches = (
        branch_lists(archive, links)
        .groupBy(key, F.col("parent_node_id").alias("node_id"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("branch_rank", "leaf_node_id", "role", "preview"))
            ).alias("alternate_branches")
        )
    )
    files = (
        attachments.groupBy(key, "node_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "ordinal", "attachment_key", "display_name", "claimed_mime", "detected_mime",
                        "byte_size", "status", "preview_kind",
                    )
                )
            ).alias("attachments")
        )
    )
    no_files = F.array().cast(files.schema["attachments"].dataType)
    no_branches = F.array().cast(branches.schema["alternate_branches"].dataType)
    rows = (
        active_path(archive, links)
        .join(files, [key, "node_id"], "left")
        .join(branches, [key, "node_id"], "left")
        .withColumn("attachments", F.coalesce("attachments", no_files))
        .withColumn("alternate_branches", F.coalesce("alternate_branches", no_branches))
    )
    shown = renderable(
        F.col("message_id"),
        F.col("message_text"),
        F.size("attachments") > 0,
        F.size("alternate_branches") > 0,
    )
    messages = (
        rows.where(shown)
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "position", "node_id", "role", "created_at", "content_type", "message_text",
                        "attachments", "alternate_branches",
                    )
                )
            ).alias("messages")
        )
    )
    headers = archive.where(F.col("reason").isNull()).select(
        key, "title", "created_at", "updated_at", "archived", "starred", "current_node"
    )
    status = path_status(archive, links).where("status IN ('OK', 'EMPTY')").select(key)
    return headers.join(status, key).join(messages, key, "left")
