"""Registered queries over the archive built from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.text import is_opaque_key
from colloquy.operators import attachments as A
from colloquy.operators import browse, graph, profile, project, render, search
from colloquy.operators.browse import ConversationQuery
from colloquy.plans.archive import Archive, build_archive
from colloquy.schemas import MAX_DOWNLOAD_BYTES
from colloquy.session import materialize
from colloquy.sources import listing, tables

_ARCHIVES: dict[tuple[str, str], Archive] = {}

# Parameters of the registered searches: one word prefix, several terms, a phrase, folded
# accents, punctuation only, blank, more than sixteen terms, and one without a hit.
SEARCHES = (
    ("q01", "the"),
    ("q02", "  the   th on "),
    ("q03", "onand"),
    ("q04", "of-the"),
    ("q05", "ÉLLE la"),
    ("q06", "que: ión"),
    ("q07", "..."),
    ("q08", "   "),
    ("q09", "a b c d e f g h i l m n o p q r zzzz"),
    ("q10", "zzzz the"),
    ("q11", "the.and.of"),
    ("q12", "UND"),
)


def archive_for(spark: SparkSession, folder: str) -> Archive:
    """The archive of a folder, ingested once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _ARCHIVES:
        _ARCHIVES[key] = build_archive(
            tables.archive_records(spark, folder), tables.attachment_files(spark, folder)
        )
    return _ARCHIVES[key]


def _on_archive(body: Callable[[Archive], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: body(archive_for(spark, folder))


def _listed(query: ConversationQuery) -> Callable[[Archive], DataFrame]:
    return lambda ar: browse.filtered(query, ar.conversations).select(*browse.LIST_COLUMNS)


def _kinds(ar: Archive) -> DataFrame:
    return browse.every_kind(ar.conversations, ar.attachments)


def _roles(ar: Archive) -> DataFrame:
    return browse.every_role(ar.conversations, ar.roles)


def _asked(ar: Archive) -> DataFrame:
    return search.search_terms(ar.spark.createDataFrame(list(SEARCHES), "query_id string, search string"))


def _terms(ar: Archive) -> DataFrame:
    """Each term and the conversations it is found in."""
    places = search.term_places(search.term_words(_asked(ar)), ar.postings)
    found = places.groupBy("query_id", "term_no").agg(
        F.sum(F.size("starts")).alias("hits"), F.count_distinct("conversation_key").alias("conversations")
    )
    terms = _asked(ar).select("query_id", "term_no", "term", F.size("words").alias("n_words"))
    return terms.join(found, ["query_id", "term_no"], "left").select(
        "query_id",
        F.col("term_no").cast("bigint").alias("term_no"),
        "term",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce("conversations", F.lit(0)).cast("bigint").alias("conversations"),
    )


def _phrases(ar: Archive) -> DataFrame:
    return search.term_hits(search.term_words(_asked(ar)), ar.postings).select(
        "query_id",
        F.col("term_no").cast("bigint").alias("term_no"),
        "conversation_key",
        "column",
        F.col("start").cast("bigint").alias("start"),
    )


def _snippets(ar: Archive) -> DataFrame:
    terms = _asked(ar)
    places = search.term_places(search.term_words(terms), ar.postings)
    return search.snippets(search.matches(terms, ar.postings), places, ar.search_documents)


SEARCH_PAGE = ConversationQuery(search="the th", role="assistant", archived=False, page=0, page_size=10)
FILTER_PAGE = ConversationQuery(
    date_from=5_000.0, date_to=90_000_000.0, starred=False, attachment_kind="pdf", page=1, page_size=7
)


def _shard_stats(ar: Archive) -> DataFrame:
    cycles = (
        graph.cycle_diagnostics(ar.table, ar.links)
        .join(ar.table.select("conversation_key", "shard_name"), "conversation_key")
        .groupBy("shard_name")
        .agg(F.sum("occurrence_count").alias("cycles"))
    )
    stats = project.shard_stats(ar.table).join(cycles, "shard_name", "left")
    return stats.select(
        "shard_name",
        "conversations_indexed",
        "conversations_skipped",
        (F.col("diagnostics") + F.coalesce("cycles", F.lit(0))).alias("diagnostics"),
    )


def _progress(ar: Archive) -> DataFrame:
    """Share of the records done after each shard, in shard order."""
    # One row per shard, so one partition is enough for the running sum.
    per_shard = project.shard_stats(ar.table).select(
        "shard_name", (F.col("conversations_indexed") + F.col("conversations_skipped")).alias("records")
    )
    order = Window.orderBy(listing.shard_order(F.col("shard_name")))
    done = F.sum("records").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("records").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per_shard.select(
        "shard_name",
        done.alias("records_done"),
        F.least(F.lit(100), F.floor(done * 100 / total + 0.5)).cast("bigint").alias("percent"),
    )


def _detail_messages(ar: Archive) -> DataFrame:
    rows = ar.detail().select("conversation_key", "title", F.posexplode("messages").alias("index", "m"))
    return rows.select(
        "conversation_key",
        "title",
        (F.col("index") + 1).cast("bigint").alias("number"),
        F.col("m.position").alias("position"),
        F.col("m.node_id").alias("node_id"),
        F.col("m.role").alias("role"),
        F.array_join(F.col("m.attachments.display_name"), "|").alias("files"),
        F.size("m.alternate_branches").cast("bigint").alias("n_branches"),
    )


def _documents(fmt: str) -> Callable[[Archive], DataFrame]:
    return lambda ar: render.documents(ar.detail(), fmt).drop("reason")


def _estimate(ar: Archive) -> DataFrame:
    detail = ar.detail()
    totals = [render.estimate(render.documents(detail, fmt)) for fmt in render.FORMATS]
    return reduce(DataFrame.unionByName, totals)


def _report(spark: SparkSession, folder: str) -> DataFrame:
    report = profile.completion(profile.structure_report(tables.archive_records(spark, folder)))
    fixed = [c for c in profile.REPORT_FIELDS if c != "knownFieldPresence"]
    return report.select(
        *fixed, *[F.col(f"knownFieldPresence.{f}").alias(f"has_{f}") for f in profile.PRESENCE_FIELDS], "completion"
    )


def _report_json(spark: SparkSession, folder: str) -> DataFrame:
    return profile.report_json(profile.structure_report(tables.archive_records(spark, folder)))


def _cycles(spark: SparkSession, folder: str) -> DataFrame:
    counters = profile.record_counters(tables.archive_records(spark, folder))
    return counters.groupBy("shard_name").agg(
        F.sum("cycles").alias("cycles"), F.sum("missing").alias("missing"), F.sum("unknown").alias("unknown"),
        F.sum("nodes").alias("nodes"),
    )


def _leaves(ar: Archive) -> DataFrame:
    """Nodes without a child."""
    rows = project.node_rows(ar.table, "node_id", "parent_node_id")
    parents = rows.select("conversation_key", F.col("parent_node_id").alias("node_id"))
    return rows.select("conversation_key", "node_id").join(parents, ["conversation_key", "node_id"], "left_anti")


def _fallback(ar: Archive) -> DataFrame:
    fell_back = F.exists("diagnostics", lambda d: d["code"] == "FALLBACK_ACTIVE_LEAF")
    return ar.table.where(fell_back).select("conversation_key", "current_node")


def _content_types(ar: Archive) -> DataFrame:
    rows = project.node_rows(ar.table, "role", "content_type", "renderable")
    return rows.groupBy("role", "content_type").agg(
        F.count("*").alias("nodes"), F.count_if("renderable").alias("renderable")
    )


def _categories(ar: Archive) -> DataFrame:
    label = A.category(F.col("detected_mime"), F.col("preview_kind"))
    return ar.attachments.groupBy("status", label.alias("category")).agg(
        F.count("*").alias("files"), F.sum("byte_size").alias("bytes")
    )


def _reference_matches(ar: Archive) -> DataFrame:
    return A.match_files(project.attachment_refs(ar.table), ar.files)


def _changed(ar: Archive) -> DataFrame:
    """Against a later snapshot in which every eleventh file has gone and some have grown."""
    digits = F.regexp_extract("name", r"([0-9]+)", 1).cast("bigint")
    later = ar.files.where(digits % 11 != 0).withColumn(
        "byte_size", F.when(digits % 13 == 0, F.col("byte_size") + 1).otherwise(F.col("byte_size"))
    )
    return A.changed_files(ar.attachments, later)


def _rejected(spark: SparkSession, folder: str) -> DataFrame:
    """References of an export in which every eleventh file is listed with a size beyond what is opened."""
    digits = F.regexp_extract("path", r"([0-9]+)", 1).cast("bigint")
    large = F.col("length") + MAX_DOWNLOAD_BYTES + 1
    files = tables.attachment_files(spark, folder).withColumn(
        "length", F.when(digits % 11 == 3, large).otherwise(F.col("length"))
    )
    typed = materialize(A.classify_files(files), "files")
    return A.resolve_attachments(project.attachment_refs(archive_for(spark, folder).table), typed)


def _postings(ar: Archive) -> DataFrame:
    return ar.postings.select(
        "token", "column", "conversation_key", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    )


def _vocabulary(ar: Archive) -> DataFrame:
    return ar.postings.groupBy("token", "column").agg(
        F.count("*").alias("conversations"), F.sum(F.size("positions")).alias("occurrences")
    )


def _opaque(ar: Archive) -> DataFrame:
    keys = project.node_rows(ar.table, "node_id", "parent_node_id", "raw_id")
    tests = [F.count_if(is_opaque_key(F.col(c))).alias(c) for c in ("conversation_key", "node_id", "parent_node_id", "raw_id")]
    return keys.agg(F.count("*").alias("rows"), *tests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = ConversationQuery
    on = _on_archive
    return {
        "p1_conversations": on(lambda ar: ar.conversations),
        "p2_quarantine": on(lambda ar: ar.quarantine.select("shard_name", "shard_ordinal", "reason")),
        "p3_nodes": on(lambda ar: ar.nodes.drop("shard_name")),
        "p10_content_types": on(_content_types),
        "p11_attachment_references": on(lambda ar: project.attachment_refs(ar.table).drop("shard_name")),
        "p17_search_documents": on(lambda ar: ar.search_documents.drop("shard_name")),
        "a3_diagnostics": on(lambda ar: ar.diagnostics),
        "a4_shard_stats": on(_shard_stats),
        "a11_progress": on(_progress),
        "a13_rejections": on(lambda ar: project.rejections(ar.table)),
        "g1_active_path": on(lambda ar: graph.active_path(ar.table, ar.links).drop("message_id")),
        "g2_path_status": on(lambda ar: graph.path_status(ar.table, ar.links)),
        "g3_descendants": on(lambda ar: graph.tree_intervals(ar.table, ar.links)),
        "g4_terminal_leaves": on(lambda ar: ar.links.select("conversation_key", "node_id", "terminal_leaf")),
        "g5_branches": on(lambda ar: graph.branch_lists(ar.table, ar.links)),
        "g6_conversation_detail": on(_detail_messages),
        "g7_all_paths": on(lambda ar: graph.all_paths(ar.table, ar.links)),
        "g8_fallback_leaf": on(_fallback),
        "g9_cycles_and_missing_references": _cycles,
        "j9_leaf_nodes": on(_leaves),
        "f1_date_range": on(_listed(q(date_from=5_000.0, date_to=70_001.0))),
        "f3_not_archived": on(_listed(q(archived=False))),
        "f3_archived": on(_listed(q(archived=True))),
        "f4_starred": on(_listed(q(starred=True))),
        "f5_has_attachments": on(_listed(q(has_attachments=True))),
        "f7_opaque_keys": on(_opaque),
        "f9_all_filters": on(
            _listed(q(date_from=float("nan"), date_to=1e9, archived=False, starred=False, has_attachments=True, role="robot"))
        ),
        "j7_attachment_kinds": on(_kinds),
        "j8_roles": on(_roles),
        "o2_filtered_page": on(lambda ar: ar.list_conversations(FILTER_PAGE)[0]),
        "o2_all_pages": on(lambda ar: browse.numbered_pages(ar.conversations, 7)),
        "o3_page_summary": on(lambda ar: ar.list_conversations(FILTER_PAGE)[1]),
        "t1_vocabulary": on(_vocabulary),
        "t2_postings": on(_postings),
        "t3_search_terms": on(_terms),
        "t5_search_matches": on(lambda ar: search.matches(_asked(ar), ar.postings)),
        "t6_phrase_hits": on(_phrases),
        "t7_snippets": on(_snippets),
        "t8_search_page": on(lambda ar: ar.list_conversations(SEARCH_PAGE)[0]),
        "t8_search_summary": on(lambda ar: ar.list_conversations(SEARCH_PAGE)[1]),
        "c1_classified_files": on(lambda ar: ar.files),
        "c5_resolved_attachments": on(lambda ar: ar.attachments),
        "c5_rejected_attachments": _rejected,
        "c6_categories": on(_categories),
        "c8_type_mismatches": on(lambda ar: A.type_mismatches(ar.attachments)),
        "c9_preview_eligible": on(lambda ar: A.preview_eligible(ar.attachments)),
        "c10_changed_files": on(_changed),
        "j4_attachment_matches": on(_reference_matches),
        "j13_attachment_records": on(lambda ar: A.attachment_records(ar.attachments)),
        "a12_unique_casefold": on(lambda ar: A.unique_casefold(ar.files)),
        "s10_text_files": lambda spark, folder: A.read_text_files(tables.attachment_files(spark, folder)),
        "e1_markdown_documents": on(_documents("md")),
        "e2_plain_documents": on(_documents("txt")),
        "a9_export_estimate": on(_estimate),
        "a6_structure_report": _report,
        "i10_structure_report_json": _report_json,
    }
