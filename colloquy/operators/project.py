"""Records to archive rows.

One JSON record is one conversation.  The whole projection is a narrow, row-local
job: header, nodes, text, attachment references, reference resolution and diagnostics
are computed inside the row with higher-order functions, and ingest moves no text
through a shuffle.  No record is refused for its size; what is read stays whole.
Reference checks use hash-based array set operations, so they stay linear in the
number of nodes.

The result is one nested row per record.  The relational tables are views over it
(see ``colloquy.plans.archive``), and column pruning keeps header-only queries
from reading message text.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schemas as S
from colloquy.functions import keys, text
from colloquy.functions import variants as V
from colloquy.functions.text import let
from colloquy.session import sql_conf


def renderable(message_id: Column, body: Column, has_attachments: Column, has_branches: Column) -> Column:
    return ~text.is_blank(body) | has_attachments | (message_id.isNotNull() & has_branches)


# The fields that are read, by the shape they must have.  Scalars stay variants, because
# their type decides whether they count.
CONTENT = "struct<content_type: variant, parts: array<variant>, text: variant, content: variant>"
PART = "struct<text: variant, content: variant>"
FILE = (
    "struct<file_id: variant, asset_pointer: variant, file_name: variant, filename: variant, id: variant, "
    "name: variant, title: variant, mime_type: variant, content_type: variant>"
)
MESSAGE = (
    "struct<id: variant, create_time: variant, author: struct<role: variant>, content: variant, "
    "metadata: struct<attachments: array<variant>>>"
)
NODE = f"struct<id: variant, parent: variant, children: array<variant>, message: {MESSAGE}>"
RECORD = (
    "struct<id: variant, conversation_id: variant, title: variant, create_time: variant, update_time: variant, "
    "is_archived: variant, archived: variant, is_starred: variant, starred: variant, current_node: variant, "
    f"mapping: map<string, {NODE}>>"
)


def _part_text(part: Column) -> Column:
    def of_object(v: Column) -> Column:
        shape = V.shaped(v, PART)
        return let(shape, lambda o: V.first_text([o["text"], o["content"]]))

    return F.coalesce(V.text_of(part), of_object(part))


def message_parts(content: Column, shape: Column) -> Column:
    """The non-null text pieces of a message, in order.

    ``shape`` is the content read as an object, null when it is a plain string.
    """
    from_parts = F.filter(F.transform(shape["parts"], _part_text), lambda t: t.isNotNull())
    whole = F.when(shape.isNull(), V.text_of(content)).otherwise(
        V.first_text([shape["text"], shape["content"]])
    )
    return F.when(shape["parts"].isNotNull(), from_parts).otherwise(F.array_compact(F.array(whole)))


def join_parts(parts: Column) -> Column:
    """Join with line feeds; a separator is added only after non-empty output."""
    joined = F.aggregate(
        parts, F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit("\n"), t))
    )
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(joined)


def _candidate(item: Column, from_metadata: bool) -> Column:
    def read(o: Column) -> Column:
        explicit = V.first_text([o["file_id"], o["asset_pointer"], o["file_name"], o["filename"]])
        name = V.first_text([o["name"], o["file_name"], o["filename"], o["title"]], S.MAX_FILENAME_BYTES)
        listed = V.first_text([o["id"], o["name"], o["title"]])
        mime = V.first_text([o["mime_type"]], S.MAX_MIME_BYTES)
        other = V.first_text([o["content_type"]], S.MAX_MIME_BYTES)
        return F.struct(
            explicit.alias("explicit"),
            (F.coalesce(explicit, listed) if from_metadata else explicit).alias("reference"),
            name.alias("name"),
            mime.alias("mime"),
            F.coalesce(mime, other).alias("claimed"),
        )

    def accept(c: Column) -> Column:
        named = c["name"].isNotNull() & (F.lit(from_metadata) | c["mime"].isNotNull())
        return F.when(
            c["explicit"].isNotNull() | named,
            F.struct(
                c["reference"].alias("reference"),
                text.clean_display_name(F.coalesce(c["name"], F.lit("Attachment"))).alias("display_name"),
                text.clean_mime(c["claimed"]).alias("claimed_mime"),
            ),
        )

    return let(V.shaped(item, FILE), lambda o: F.when(o.isNotNull(), let(read(o), accept)))


def attachment_candidates(listed: Column, parts: Column) -> Column:
    """References from the metadata list, then from the content parts."""

    def pick(items: Column, from_metadata: bool) -> Column:
        known = F.coalesce(items, F.array().cast("array<variant>"))
        found = F.transform(known, lambda item: _candidate(item, from_metadata))
        return F.filter(found, lambda item: item.isNotNull())

    return F.concat(pick(listed, True), pick(parts, False))


def _read_node(entry: Column) -> Column:
    node = entry["value"]
    message = node["message"]

    def with_content(shape: Column) -> Column:
        kind = text.byte_truncate(V.text_of(shape["content_type"]), S.MAX_CONTENT_TYPE_BYTES)
        return F.struct(
            entry["key"].alias("map_key"),
            node.isNotNull().alias("is_object"),
            F.coalesce(V.first_text([node["id"]]), entry["key"]).alias("raw_id"),
            V.first_text([node["parent"]]).alias("parent"),
            F.transform(
                F.coalesce(node["children"], F.array().cast("array<variant>")), V.text_of
            ).alias("children"),
            V.first_text([message["id"]]).alias("message"),
            text.normalize_role(V.text_of(message["author"]["role"])).alias("role"),
            V.number_of(message["create_time"]).alias("created_at"),
            F.coalesce(kind, F.lit("text")).alias("content_type"),
            let(message_parts(message["content"], shape), join_parts).alias("joined"),
            attachment_candidates(message["metadata"]["attachments"], shape["parts"]).alias("candidates"),
        )

    return let(V.shaped(message["content"], CONTENT), with_content)


def with_doc(records: DataFrame) -> DataFrame:
    """Adds the parsed ``doc`` and the record's size; drops the text.

    A source that has parsed a record already passes ``doc``.  Of a repeated key the
    last value counts.
    """
    # The parser takes its rule for repeated keys when the plan is made.
    with sql_conf(records.sparkSession, spark__sql__variant__allowDuplicateKeys="true"):
        size = F.octet_length("record").cast("bigint")
        parsed = V.strict_json(F.col("record"))
        if "doc" in records.columns:
            parsed = F.coalesce("doc", parsed)
        staged = records.withColumns({"record_bytes": size, "doc": parsed})
        return staged.drop("record")


def parse_records(records: DataFrame) -> DataFrame:
    """Parsed records with a reason for each refused one."""
    parsed = with_doc(records)
    parsed = parsed.withColumns(
        {"malformed": F.col("doc").isNull(), "r": V.shaped(F.col("doc"), RECORD)}
    ).drop("doc")
    reason = (
        F.when(F.col("malformed"), "MALFORMED_RECORD")
        .when(F.col("r.mapping").isNull(), "UNSUPPORTED_RECORD")
    )
    return parsed.withColumn("reason", reason).drop("malformed")


def project_records(records: DataFrame) -> DataFrame:
    """One nested row per record of ``(shard_name, shard_ordinal, record)``.

    A refused record keeps its row with ``reason`` set and no nodes.
    """
    steps, columns = _projection(records.sparkSession.sparkContext.applicationId)
    table = parse_records(records)
    for step in steps:
        table = table.withColumns(step)
    return table.select(*columns)


@cache
def _projection(application: str) -> tuple[list[dict[str, Column]], list[Column]]:
    """The steps of the projection, each by name, and the final columns.

    They only name columns, so an application makes them once and uses them on any
    records.
    """
    r = F.col("r")
    source_id = V.first_text([r["id"], r["conversation_id"]])
    usable = F.when(F.col("reason").isNull(), F.map_entries(r["mapping"]))
    read = {
        "all_nodes": F.transform(usable, _read_node),
        "conversation_key": keys.conversation_key(F.col("shard_name"), F.col("shard_ordinal"), source_id),
        "raw_current": V.first_text([r["current_node"]]),
        "header_title": text.clean_title(V.text_of(r["title"])),
        "created_at": V.number_of(r["create_time"]),
        "updated_at": V.number_of(r["update_time"]),
        "archived": V.first_flag([r["is_archived"], r["archived"]]),
        "starred": V.first_flag([r["is_starred"], r["starred"]]),
    }
    lists = {
        "objects": F.filter("all_nodes", lambda n: n["is_object"]),
        "map_keys": F.col("all_nodes.map_key"),
    }
    # Of nodes that repeat an id the first one counts.  Ids hardly ever repeat, so the
    # places are looked up only then.
    seen = F.col("objects.raw_id")
    repeats = F.size(F.array_distinct(seen)) < F.size(seen)
    firsts = F.filter("objects", lambda n, i: F.array_position(seen, n["raw_id"]) == i + 1)
    unique = {"nodes0": F.when(repeats, firsts).otherwise(F.col("objects"))}
    refs = F.array_union(
        F.col("nodes0.parent"), F.array_append(F.flatten("nodes0.children"), F.col("raw_current"))
    )
    references = {
        "ids": F.col("nodes0.raw_id"),
        "unknown": F.array_compact(F.array_except(refs, F.array_union(F.col("nodes0.raw_id"), F.col("map_keys")))),
        # A map key that differs from the node's own id is an alias of that id.
        "alias_only": F.array_except(F.col("map_keys"), F.col("nodes0.raw_id")),
    }
    alias = F.map_from_entries(
        F.transform(
            F.filter("nodes0", lambda n: F.array_contains(F.col("alias_only"), n["map_key"])),
            lambda n: F.struct(n["map_key"], n["raw_id"]),
        )
    )

    def resolve(ref: Column) -> Column:
        found = ~F.array_contains(F.col("unknown"), ref)
        return F.when(found, F.coalesce(F.try_element_at(F.col("alias"), ref), ref))

    judged = {"alias": alias}

    def finish(n: Column, position: Column) -> Column:
        attachments = F.array_distinct(n["candidates"])
        message_id = keys.message_key(F.col("conversation_key"), n["message"])
        refs = n["children"]
        lost = F.size(F.filter(refs, lambda r: F.array_contains(F.col("unknown"), r)))
        invalid = F.size(F.filter(refs, lambda r: r.isNull()))
        return F.struct(
            position.cast("bigint").alias("position"),
            n["raw_id"].alias("raw_id"),
            keys.node_key(F.col("conversation_key"), n["raw_id"]).alias("node_id"),
            keys.node_key(F.col("conversation_key"), resolve(n["parent"])).alias("parent_node_id"),
            message_id.alias("message_id"),
            n["role"].alias("role"),
            n["created_at"].alias("created_at"),
            n["content_type"].alias("content_type"),
            text.strip_markers(n["joined"]).alias("message_text"),
            attachments.alias("attachments"),
            F.coalesce(F.array_contains(F.col("unknown"), n["parent"]), F.lit(False)).alias("missing_parent"),
            invalid.cast("bigint").alias("invalid_children"),
            lost.cast("bigint").alias("missing_children"),
            (F.size(refs) - lost - invalid).alias("n_children"),
        )

    def mark(n: Column) -> Column:
        has_files = F.size(n["attachments"]) > 0
        shown = renderable(n["message_id"], n["message_text"], has_files, n["n_children"] > 1)
        return n.withField("renderable", shown)

    current = keys.node_key(F.col("conversation_key"), resolve(F.col("raw_current")))
    ranked = F.transform(
        F.filter(
            "nodes",
            lambda n: F.array_contains(F.col("leaf_ids"), n["node_id"]),
        ),
        lambda n: F.struct(n["created_at"].alias("created_at"), n["node_id"].alias("node_id")),
    )
    shaped = {
        "nodes1": F.transform(F.when(F.col("reason").isNull(), F.col("nodes0")), finish),
        "resolved_current": current,
    }
    marked = {"nodes": F.transform("nodes1", mark)}
    # A node that no parent reference names; needed only without a current node.
    leaves = F.array_except(F.col("nodes.node_id"), F.col("nodes.parent_node_id"))
    leaf_ids = {"leaf_ids": F.when(F.col("resolved_current").isNull(), leaves)}
    # Null times sort lowest, then the larger key wins.
    fallback = {"fallback": F.array_max(ranked)["node_id"]}

    def total(field: str) -> Column:
        return F.aggregate("nodes", F.lit(0).cast("bigint"), lambda acc, n: acc + n[field].cast("bigint"))

    counts = [
        ("INVALID_NODE", (F.size("all_nodes") - F.size("objects")).cast("bigint")),
        ("DUPLICATE_NODE_ID", (F.size("objects") - F.size("nodes")).cast("bigint")),
        ("MISSING_PARENT", total("missing_parent")),
        ("INVALID_CHILD_REFERENCE", total("invalid_children")),
        ("MISSING_CHILD", total("missing_children")),
        (
            "MISSING_CURRENT_NODE",
            (F.col("raw_current").isNotNull() & F.col("resolved_current").isNull()).cast("bigint"),
        ),
        (
            "FALLBACK_ACTIVE_LEAF",
            (F.col("resolved_current").isNull() & F.col("fallback").isNotNull()).cast("bigint"),
        ),
    ]
    diagnostics = F.filter(
        F.array(*[F.struct(F.lit(code).alias("code"), n.alias("occurrence_count")) for code, n in counts]),
        lambda d: d["occurrence_count"] > 0,
    )
    ok = F.col("reason").isNull()
    columns = [
        F.col("shard_name"),
        F.col("shard_ordinal").cast("bigint").alias("shard_ordinal"),
        F.col("record_bytes"),
        F.col("reason"),
        F.when(ok, F.col("conversation_key")).alias("conversation_key"),
        F.when(ok, F.col("header_title")).alias("title"),
        F.when(ok, F.col("created_at")).alias("created_at"),
        F.when(ok, F.col("updated_at")).alias("updated_at"),
        F.when(ok, F.col("archived")).alias("archived"),
        F.when(ok, F.col("starred")).alias("starred"),
        F.when(ok, F.coalesce("resolved_current", "fallback")).alias("current_node"),
        F.when(ok, F.size("nodes").cast("bigint")).alias("n_nodes"),
        F.when(ok, total("renderable")).alias("message_count"),
        F.when(ok, F.exists("nodes", lambda n: F.size(n["attachments"]) > 0)).alias("has_attachments"),
        F.when(ok, diagnostics).alias("diagnostics"),
        F.transform(
            "nodes",
            lambda n: n.dropFields("missing_parent", "invalid_children", "missing_children", "n_children"),
        ).alias("nodes"),
    ]
    return [read, lists, unique, references, judged, shaped, marked, leaf_ids, fallback], columns


# ---------------------------------------------------------------- table views


def conversations(archive: DataFrame) -> DataFrame:
    return archive.where(F.col("reason").isNull()).select(*S.CONVERSATION_COLUMNS)


def node_rows(archive: DataFrame, *fields: str, keep: tuple[str, ...] = ("conversation_key",)) -> DataFrame:
    """One row per node with the named node fields only.

    Zipping the single fields (instead of exploding whole structs) lets the scan
    prune the others, so skeleton queries do not read message text.
    """
    zipped = F.arrays_zip(*[F.col(f"nodes.{field}") for field in fields])
    rows = archive.where(F.col("reason").isNull()).select(*keep, F.explode(zipped).alias("n"))
    return rows.select(*keep, *[F.col(f"n.{field}") for field in fields])


def nodes(archive: DataFrame) -> DataFrame:
    fields = ("node_id", "parent_node_id", "message_id", "role", "created_at", "content_type", "message_text")
    rows = node_rows(archive, *fields, "attachments", keep=("shard_name", "conversation_key"))
    return rows.select(
        "shard_name", "conversation_key", *fields, (F.size("attachments") > 0).alias("has_attachments")
    )


def attachment_refs(archive: DataFrame) -> DataFrame:
    """One row per distinct reference of a message, with its ordinal and key."""
    keep = ("shard_name", "conversation_key")
    rows = node_rows(archive.where("has_attachments"), "node_id", "attachments", keep=keep).select(
        *keep, "node_id", F.posexplode("attachments").alias("ordinal", "a")
    )
    return rows.select(
        "shard_name",
        keys.attachment_key(F.col("conversation_key"), F.col("node_id"), F.col("ordinal")).alias("attachment_key"),
        "conversation_key",
        "node_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("a.reference"),
        F.col("a.display_name"),
        F.col("a.claimed_mime"),
    )


def diagnostics(archive: DataFrame) -> DataFrame:
    return archive.select("conversation_key", F.inline("diagnostics"))


def search_documents(archive: DataFrame) -> DataFrame:
    """Title and the non-blank node texts of each conversation, in node order."""
    texts = F.filter(F.col("nodes.message_text"), lambda t: ~text.is_blank(t))
    return archive.where(F.col("reason").isNull()).select(
        "shard_name", "conversation_key", "title", F.array_join(texts, "\n").alias("body")
    )


def quarantine(archive: DataFrame) -> DataFrame:
    refused = F.col("reason").isNotNull() & F.col("shard_ordinal").isNotNull()
    return archive.where(refused).select(
        "shard_name", "shard_ordinal", "reason", F.col("record_bytes").alias("bytes")
    )


def shard_stats(archive: DataFrame) -> DataFrame:
    """Records indexed and skipped, anomalies and bytes per shard."""
    anomalies = F.aggregate(
        "diagnostics", F.lit(0).cast("bigint"), lambda acc, d: acc + d["occurrence_count"]
    )
    skipped = F.col("reason").isNotNull()
    return archive.groupBy("shard_name").agg(
        F.count_if(~skipped).alias("conversations_indexed"),
        F.count_if(skipped).alias("conversations_skipped"),
        F.sum(F.when(skipped, F.lit(1)).otherwise(anomalies)).alias("diagnostics"),
        F.sum("record_bytes").alias("bytes_processed"),
    )


def rejections(archive: DataFrame) -> DataFrame:
    return quarantine(archive).groupBy("shard_name", "reason").agg(F.count("*").alias("records"))
