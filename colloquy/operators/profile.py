"""Structure profile: value-free counters over an archive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import variants as V
from colloquy.operators.project import with_doc
from colloquy.session import materialize

# Known keys at each level, and the report's field names.
CONVERSATION_KEYS = (
    "id", "conversation_id", "title", "create_time", "update_time", "mapping", "current_node",
    "is_archived", "archived", "is_starred", "starred",
)
NODE_KEYS = ("id", "message", "parent", "children")
MESSAGE_KEYS = (
    "id", "author", "create_time", "update_time", "content", "status", "end_turn", "weight",
    "metadata", "recipient", "channel",
)
AUTHOR_KEYS = ("role", "name", "metadata")
CONTENT_KEYS = ("content_type", "parts", "text")
REPORT_FIELDS = (
    "shardCount", "parsedShardCount", "malformedShardCount", "conversationRecordCount",
    "objectRecordCount", "nonObjectRecordCount", "knownFieldPresence", "mappingNodeCount",
    "missingReferenceCount", "cycleCount", "oversizedRecordCount", "unknownKeyCount", "sourceUnchanged",
)
# Records of more bytes are counted as oversized; they are read like the others.
OVERSIZED_BYTES = 32 * 1024 * 1024
PRESENCE_FIELDS = (
    "id", "conversationId", "title", "createTime", "updateTime", "mapping", "currentNode",
    "isArchived", "archived", "isStarred", "starred",
)


def back_edges(edges: list[tuple[int, int]], n: int) -> int:
    """Back edges of a depth-first walk over distinct edges, in the order of the nodes."""
    if all(a < b for a, b in edges):
        return 0
    targets: list[list[int]] = [[] for _ in range(n)]
    for a, b in sorted(set(edges), reverse=True):
        targets[a].append(b)
    on_walk, left = [False] * n, [True] * n
    found = 0
    for root in range(n):
        stack = [root] if left[root] else []
        while stack:
            node = stack[-1]
            if left[node]:
                left[node], on_walk[node] = False, True
            if not targets[node]:
                on_walk[node] = False
                stack.pop()
                continue
            ahead = targets[node].pop()
            found += on_walk[ahead]
            if left[ahead]:
                stack.append(ahead)
    return found


@F.pandas_udf(T.LongType())
def cycle_counts(names: pd.Series, owners: pd.Series, sources: pd.Series, targets: pd.Series, n_parents: pd.Series) -> pd.Series:
    """Cycles of each record: names and the nodes they stand for, then references, those to parents first."""
    out = []
    for name, owner, source, target, parents in zip(names, owners, sources, targets, n_parents):
        if name is None:
            out.append(None)
            continue
        parents = int(parents)
        # Of nodes that share a name the first one stands; references to no node are left out.
        node_of = dict(zip(name[::-1], owner[::-1]))
        ends = [(a, node_of[b]) for a, b in zip(source[:parents], target[:parents]) if b in node_of]
        downward = [(a, node_of[b]) for a, b in zip(source[parents:], target[parents:]) if b in node_of]
        out.append(back_edges([(b, a) for a, b in ends] + downward, 1 + max(owner, default=-1)))
    return pd.Series(out, dtype="Int64")


def with_references(rows: DataFrame, doc: Column, string_children) -> DataFrame:
    """Add ``missing`` and ``cycles``.  Names and references are flat arrays; missing ones are counted by set operations."""

    def pairs(values: Column) -> Column:
        """(place, text) of an array, without nulls."""
        placed = F.transform(values, lambda v, i: F.struct(i.alias("at"), v.alias("text")))
        return F.filter(placed, lambda p: p["text"].isNotNull())

    entries = F.col("entries")
    ids = F.transform(entries, lambda n: V.string_at(n, "$.id"))
    own = F.flatten(F.transform(F.arrays_zip(F.map_keys("mapping").alias("key"), ids.alias("id")), lambda p, i: F.array(
        F.struct(i.alias("at"), p["key"].alias("text")), F.struct(i.alias("at"), p["id"].alias("text")))))
    children = F.transform(entries, lambda n, i: F.transform(
        F.coalesce(string_children(n), F.array().cast("array<string>")), lambda c: F.struct(i.alias("at"), c.alias("text"))))
    rows = rows.withColumns({
        "names": F.filter(own, lambda p: p["text"].isNotNull()),
        "up": pairs(F.transform(entries, lambda n: V.string_at(n, "$.parent"))),
        "down": F.flatten(children),
        "current": V.string_at(doc, "$.current_node"),
    }).withColumn("links", F.concat("up", "down"))
    lost = F.array_except(F.array_append(F.col("links.text"), F.col("current")), F.col("names.text"))
    rows = rows.withColumn("lost", F.array_compact(lost))
    gone = F.size(F.filter("links", lambda r: F.array_contains(F.col("lost"), r["text"])))
    now = F.coalesce(F.array_contains("lost", F.col("current")), F.lit(False)).cast("int")
    cycles = cycle_counts("names.text", "names.at", "links.at", "links.text", F.size("up"))
    return rows.withColumns({"missing": (gone + now).cast("bigint"), "cycles": cycles})


def _unknown(obj: Column, known: tuple[str, ...]) -> Column:
    extra = F.filter(F.map_keys(obj), lambda k: ~k.isin(*known))
    return F.coalesce(F.size(extra), F.lit(0)).cast("bigint")


def record_counters(records: DataFrame) -> DataFrame:
    """Counters of each record.  Row-local; Python sees ids only, never text."""
    doc = F.col("doc")
    rows = (
        with_doc(records)
        .withColumn("oversized", F.coalesce(F.col("record_bytes") > OVERSIZED_BYTES, F.lit(False)))
        .withColumns({"top": V.object_at(doc, "$"), "mapping": V.object_at(doc, "$.mapping")})
        .withColumns({"entries": F.map_values("mapping"), "is_object": F.col("top").isNotNull()})
    )
    string_children = lambda n: F.array_compact(
        F.transform(V.array_at(n, "$.children"), lambda ch: V.string_at(ch, "$"))
    )
    rows = with_references(rows, doc, string_children)
    inner = F.aggregate(
        "entries",
        F.lit(0).cast("bigint"),
        lambda acc, n: acc
        + _unknown(V.object_at(n, "$"), NODE_KEYS)
        + _unknown(V.object_at(n, "$.message"), MESSAGE_KEYS)
        + _unknown(V.object_at(n, "$.message.author"), AUTHOR_KEYS)
        + _unknown(V.object_at(n, "$.message.content"), CONTENT_KEYS),
    )
    present = [
        F.coalesce(F.map_contains_key("top", key), F.lit(False)).cast("bigint").alias(name)
        for key, name in zip(CONVERSATION_KEYS, PRESENCE_FIELDS)
    ]
    return rows.select(
        "shard_name",
        "shard_ordinal",
        "oversized",
        F.col("doc").isNull().alias("malformed"),
        "is_object",
        F.struct(*present).alias("present"),
        F.coalesce(F.size("mapping"), F.lit(0)).cast("bigint").alias("nodes"),
        F.coalesce("missing", F.lit(0).cast("bigint")).alias("missing"),
        F.coalesce("cycles", F.lit(0).cast("bigint")).alias("cycles"),
        (_unknown(F.col("top"), CONVERSATION_KEYS) + F.coalesce(inner, F.lit(0).cast("bigint"))).alias("unknown"),
    )


def structure_report(records: DataFrame, malformed_shards: DataFrame | None = None, source_unchanged: bool = True) -> DataFrame:
    """The fixed report as one row: one aggregate per shard, then one over shards.

    A shard with a malformed element counts as malformed, and its elements after the
    first such one are not counted.  ``malformed_shards`` names shards that could not
    be cut into elements at all.
    """
    everything = materialize(record_counters(records), "profile")
    first_bad = everything.where("malformed").groupBy("shard_name").agg(F.min("shard_ordinal").alias("first_bad"))
    counters = everything.join(first_bad, "shard_name", "left").where(
        F.col("first_bad").isNull() | (F.col("shard_ordinal") <= F.col("first_bad"))
    )
    sums = [F.sum(f"present.{f}").alias(f"p_{f}") for f in PRESENCE_FIELDS]
    per_shard = counters.groupBy("shard_name").agg(
        F.bool_or("malformed").alias("bad"),
        F.count("*").alias("records"),
        F.count_if("is_object").alias("objects"),
        F.count_if(~F.col("is_object") & ~F.col("malformed")).alias("others"),
        F.count_if("oversized").alias("oversized"),
        F.sum("nodes").alias("nodes"),
        F.sum("missing").alias("missing"),
        F.sum("cycles").alias("cycles"),
        F.sum("unknown").alias("unknown"),
        *sums,
    )
    if malformed_shards is not None:
        per_shard = per_shard.unionByName(
            malformed_shards.select("shard_name", F.lit(True).alias("bad")), allowMissingColumns=True
        ).groupBy("shard_name").agg(
            F.bool_or("bad").alias("bad"), *[F.sum(c).alias(c) for c in per_shard.columns[2:]]
        )

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    report = per_shard.agg(
        F.count("*").alias("shardCount"),
        F.count_if(~F.col("bad")).alias("parsedShardCount"),
        F.count_if("bad").alias("malformedShardCount"),
        total("records").alias("conversationRecordCount"),
        total("objects").alias("objectRecordCount"),
        total("others").alias("nonObjectRecordCount"),
        F.struct(*[total(f"p_{f}").alias(f) for f in PRESENCE_FIELDS]).alias("knownFieldPresence"),
        total("nodes").alias("mappingNodeCount"),
        total("missing").alias("missingReferenceCount"),
        total("cycles").alias("cycleCount"),
        total("oversized").alias("oversizedRecordCount"),
        total("unknown").alias("unknownKeyCount"),
    )
    return report.withColumn("sourceUnchanged", F.lit(source_unchanged))


def completion(report: DataFrame) -> DataFrame:
    """complete, partial, or rejected when there was no shard at all."""
    partial = (
        (F.col("malformedShardCount") > 0) | ~F.col("sourceUnchanged")
    )
    status = F.when(F.col("shardCount") == 0, "rejected").when(partial, "partial").otherwise("complete")
    return report.withColumn("completion", status)


def empty_report(spark: SparkSession) -> DataFrame:
    """The report of an archive that could not be read."""
    zero = F.lit(0).cast("bigint")
    fields = {name: zero for name in REPORT_FIELDS}
    fields["knownFieldPresence"] = F.struct(*[zero.alias(f) for f in PRESENCE_FIELDS])
    fields["sourceUnchanged"] = F.lit(False)
    return spark.range(1).select(*[fields[name].alias(name) for name in REPORT_FIELDS])


def report_json(report: DataFrame) -> DataFrame:
    """The report as JSON with exactly the fixed fields; any other shape gives the empty one."""
    types = {f.name: f.dataType.simpleString() for f in report.schema.fields}
    counts = [name for name in REPORT_FIELDS if name not in ("knownFieldPresence", "sourceUnchanged")]
    valid = (
        all(types.get(name) == "bigint" for name in counts)
        and types.get("sourceUnchanged") == "boolean"
        and types.get("knownFieldPresence") == f"struct<{','.join(f + ':bigint' for f in PRESENCE_FIELDS)}>"
    )
    chosen = report if valid else empty_report(report.sparkSession)
    return chosen.select(F.to_json(F.struct(*REPORT_FIELDS)).alias("report"))
