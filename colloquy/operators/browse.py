"""The list query: present filters only, effective-time order, pages."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import schemas as S
from colloquy.functions.text import is_opaque_key
from colloquy.session import checkpoint


@dataclass(frozen=True)
class ConversationQuery:
    """Filters that are ``None`` are not applied."""

    search: str | None = None
    date_from: float | None = None
    date_to: float | None = None
    archived: bool | None = None
    starred: bool | None = None
    has_attachments: bool | None = None
    attachment_kind: str | None = None
    role: str | None = None
    page: int | None = None
    page_size: int | None = None

    @property
    def offset_and_limit(self) -> tuple[int, int]:
        size = S.DEFAULT_PAGE_SIZE if self.page_size is None else self.page_size
        size = max(size, 1)
        return (self.page or 0) * size, size


def effective_time() -> Column:
    return F.coalesce("updated_at", "created_at", F.lit(0.0))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First and last millisecond of a day in the session time zone, as epoch seconds."""
    start = F.unix_millis(F.to_timestamp(day))
    after = F.unix_millis(F.to_timestamp(F.date_add(F.to_date(day), 1)))
    return start / 1000.0, (after - 1) / 1000.0


def flag(name: str, wanted: bool) -> Column:
    """True needs an explicit true; false also takes an absent flag."""
    value = F.coalesce(F.col(name), F.lit(False))
    return value if wanted else ~value


def kind_condition(kind: str) -> Column:
    mime = F.col("detected_mime")
    families = {name: mime.ilike(f"{name}/%") for name in ("image", "audio", "video", "text")}
    families["pdf"] = mime == "application/pdf"
    if kind == "missing":
        return F.col("status") == "missing"
    if kind == "other":
        in_family = reduce(lambda a, b: a | b, families.values())
        return (F.col("status") != "missing") & ~F.coalesce(in_family, F.lit(False))
    return families[kind]


def with_kind(conversations: DataFrame, attachments: DataFrame, kind: str) -> DataFrame:
    keys = attachments.where(kind_condition(kind)).select("conversation_key")
    return conversations.join(keys, "conversation_key", "left_semi")


def with_role(conversations: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """``roles`` is ``(conversation_key, role)`` over all nodes, also structural ones."""
    keys = roles.where(F.col("role") == role).select("conversation_key")
    return conversations.join(keys, "conversation_key", "left_semi")


def every_kind(conversations: DataFrame, attachments: DataFrame) -> DataFrame:
    """``(kind, conversation_key)`` of all kinds in one pass over the attachments."""
    kinds = F.array_compact(F.array(*[F.when(kind_condition(kind), F.lit(kind)) for kind in S.ATTACHMENT_KINDS]))
    found = attachments.select("conversation_key", F.explode(kinds).alias("kind")).distinct()
    return found.join(conversations.select("conversation_key"), "conversation_key", "left_semi").select("kind", "conversation_key")


def every_role(conversations: DataFrame, roles: DataFrame) -> DataFrame:
    """``(role, conversation_key)`` of all roles in one pass over the nodes."""
    found = roles.where(F.col("role").isin(*S.ROLES)).select("role", "conversation_key").distinct()
    return found.join(conversations.select("conversation_key"), "conversation_key", "left_semi").select("role", "conversation_key")


def conditions(query: ConversationQuery) -> list[Column]:
    found = []
    if query.date_from is not None and math.isfinite(query.date_from):
        found.append(effective_time() >= query.date_from)
    if query.date_to is not None and math.isfinite(query.date_to):
        found.append(effective_time() <= query.date_to)
    if query.archived is not None:
        found.append(flag("archived", query.archived))
    if query.starred is not None:
        found.append(flag("starred", query.starred))
    if query.has_attachments is not None:
        found.append(F.col("has_attachments") == query.has_attachments)
    return found


def filtered(
    query: ConversationQuery,
    conversations: DataFrame,
    attachments: DataFrame | None = None,
    roles: DataFrame | None = None,
    hits: DataFrame | None = None,
) -> DataFrame:
    """Header rows that pass; joins only for the filters in use.

    ``hits`` are the ``conversation_key`` rows of the search, when there is one.
    """
    tests = conditions(query)
    rows = conversations.where(reduce(and_, tests)) if tests else conversations
    if hits is not None:
        rows = rows.join(hits.select("conversation_key"), "conversation_key", "left_semi")
    if query.attachment_kind is not None:
        rows = with_kind(rows, attachments, query.attachment_kind)
    if query.role in S.ROLES:
        rows = with_role(rows, roles, query.role)
    return rows


def list_order() -> tuple[Column, Column]:
    return effective_time().desc(), F.col("conversation_key").asc()


LIST_COLUMNS = (
    "conversation_key", "title", "created_at", "updated_at", "archived", "starred",
    "has_attachments", "message_count",
)


def page_of(rows: DataFrame, query: ConversationQuery) -> DataFrame:
    """One page, newest first.  A top-k, so only the page is sorted to the end."""
    offset, size = query.offset_and_limit
    return rows.select(*LIST_COLUMNS).orderBy(*list_order()).offset(offset).limit(size)


def page_summary(rows: DataFrame, query: ConversationQuery) -> DataFrame:
    """Total, pages and whether more rows follow this page."""
    offset, size = query.offset_and_limit
    total = F.col("total")
    on_page = F.least(F.greatest(total - offset, F.lit(0)), F.lit(size))
    return rows.agg(F.count("*").alias("total")).select(
        "total",
        F.greatest(F.ceil(total / size), F.lit(1)).cast("bigint").alias("total_pages"),
        on_page.cast("bigint").alias("items"),
        (F.lit(offset) + on_page < total).alias("has_more"),
    )


def numbered_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """Page number of every row, for handing out all pages in one job.

    Ranks are built from counts: rows are range-partitioned in list order and ranked
    inside their range, and each range starts after the rows of the ranges before it.
    The ranges are as many as the shuffle partitions, so the count table is small, and
    no task sees all rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpoint(
        rows.select(*LIST_COLUMNS)
        .repartitionByRange(parts, *list_order())
        .withColumn("part", F.spark_partition_id())
    )
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*list_order()))
    size = max(page_size, 1)
    return (
        ordered.withColumn("rank", rank)
        .join(F.broadcast(before), "part")  # one row per shuffle partition
        .withColumn("rank", F.col("rank") + F.col("before") - 1)
        .select("conversation_key", F.col("rank").cast("bigint").alias("rank"), F.floor(F.col("rank") / size).alias("page"))
    )


def one_conversation(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one conversation; a malformed key is refused."""
    checked = F.when(is_opaque_key(F.lit(key)), F.lit(key)).otherwise(
        F.raise_error(F.lit("not a conversation key")).cast("string")
    )
    return rows.where(F.col("conversation_key") == checked)
