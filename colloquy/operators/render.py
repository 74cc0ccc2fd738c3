"""Transcripts: one Markdown or plain-text document row per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.markdown import markdown_text
from colloquy.functions.text import (
    display_role, display_title, encode_controls, export_file_name, is_blank, let, markdown_inline,
    plain_seconds,
)

# Texts of an exported document.
PRIVACY_NOTICE = (
    "This document contains private conversation data. "
    "Uploading or sharing it transfers that data under the destination provider's policies."
)
ATTACHMENT_NOTICE = "Attachments are not included in this export."
FORMATS = ("md", "txt")


def omitted_notice(n: Column) -> Column:
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.lit(" (1 attachment omitted.)"))
        .otherwise(F.concat(F.lit(" ("), n.cast("string"), F.lit(" attachments omitted.)")))
    )


def _ended(c: Column) -> Column:
    return let(c, lambda v: F.when(v.endswith("\n"), v).otherwise(F.concat(v, F.lit("\n"))))


def message_rows(detail: DataFrame) -> DataFrame:
    """Shown messages with their number."""
    rows = detail.select("conversation_key", F.posexplode("messages").alias("index", "m"))
    return rows.select(
        "conversation_key",
        (F.col("index") + 1).alias("number"),
        F.col("m.role").alias("role"),
        F.col("m.created_at").alias("created_at"),
        F.col("m.message_text").alias("message_text"),
        F.size("m.attachments").alias("n_attachments"),
    )


def _markdown_block(text: Column) -> Column:
    at = plain_seconds(F.col("created_at"))
    return F.concat(
        F.lit("\n## "), F.col("number").cast("string"), F.lit(". "),
        markdown_inline(display_role(F.col("role"))), F.lit("\n"),
        F.coalesce(F.concat(F.lit("\nTimestamp (Unix seconds): `"), at, F.lit("`\n")), F.lit("")),
        F.lit("\n"),
        F.when(is_blank(F.col("message_text")), F.lit("_No text content._\n")).otherwise(_ended(text)),
    )


def _plain_block(text: Column) -> Column:
    at = plain_seconds(F.col("created_at"))
    return F.concat(
        F.lit("\n["), F.col("number").cast("string"), F.lit("] "), display_role(F.col("role")),
        F.lit("\n" + "-" * 40 + "\n"),
        F.coalesce(F.concat(F.lit("Timestamp (Unix seconds): "), at, F.lit("\n\n")), F.lit("")),
        F.when(is_blank(F.col("message_text")), F.lit("(No text content.)\n")).otherwise(_ended(text)),
    )


def _heading(fmt: str, title: Column, n: Column) -> Column:
    if fmt == "md":
        return F.concat(
            F.lit("# "), markdown_inline(title), F.lit(f"\n\n> {PRIVACY_NOTICE}\n>\n> {ATTACHMENT_NOTICE}"),
            omitted_notice(n), F.lit("\n"),
        )
    rule = F.repeat(F.lit("="), F.least(F.greatest(F.length(title), F.lit(3)), F.lit(72)))
    return F.concat(
        title, F.lit("\n"), rule, F.lit(f"\n\n{PRIVACY_NOTICE}\n{ATTACHMENT_NOTICE}"),
        omitted_notice(n), F.lit("\n"),
    )


def documents(detail: DataFrame, fmt: str, max_bytes: int | None = None) -> DataFrame:
    """One document per conversation.

    With a size limit, documents beyond it get a ``reason`` and no text.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    key = "conversation_key"
    block = (
        _markdown_block(markdown_text(F.col("message_text")))
        if fmt == "md"
        else _plain_block(encode_controls(F.col("message_text")))
    )
    blocks = message_rows(detail).select(key, "number", "n_attachments", block.alias("block"))
    bodies = blocks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("blocks"),
        F.count("*").alias("message_count"),
        F.sum("n_attachments").alias("attachment_count"),
    )
    n = F.coalesce("attachment_count", F.lit(0))
    joined = detail.select(key, "title").join(bodies, key, "left")
    text = F.concat(
        _heading(fmt, display_title(F.col("title")), n),
        F.coalesce(F.array_join(F.col("blocks.block"), ""), F.lit("")),
    )
    built = joined.select(
        key,
        F.lit(fmt).alias("format"),
        export_file_name(F.col("title"), fmt).alias("file_name"),
        F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"),
        n.cast("bigint").alias("attachment_count"),
        text.alias("document"),
    ).withColumn("byte_size", F.octet_length("document").cast("bigint"))
    too_big = F.lit(False) if max_bytes is None else F.col("byte_size") > max_bytes
    return built.withColumn("reason", F.when(too_big, "RESOURCE_LIMIT")).withColumn(
        "document", F.when(~too_big, F.col("document"))
    )


def estimate(docs: DataFrame) -> DataFrame:
    """Totals of an export."""
    return docs.where(F.col("reason").isNull()).groupBy("format").agg(
        F.count("*").alias("conversation_count"),
        F.sum("message_count").alias("message_count"),
        F.sum("attachment_count").alias("attachment_count"),
        F.sum("byte_size").alias("byte_size"),
    )


def write_documents(docs: DataFrame, path: str) -> None:
    docs.where(F.col("reason").isNull()).drop("reason").write.mode("overwrite").partitionBy("format").parquet(path)
