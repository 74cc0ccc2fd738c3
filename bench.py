"""Headline timings: one JSON line.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_PROFILE  "full" adds the published scale profiles (default), "tables" leaves them out

Each query runs once on the smallest tables first, so that start-up and code generation
are not what is measured.  An archive is built once (``ingest``, ``links``, ``attachments``,
``postings``); the queries after that read it.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from colloquy.operators import attachments as A
from colloquy.operators.browse import ConversationQuery
from colloquy.plans import archive_queries, registry
from colloquy.plans.archive import Archive, build_archive
from colloquy.plans.ingest import ingest_shards
from colloquy.session import materialize, scratch_path
from colloquy.sources import listing, tables

HEADLINE = (
    "p1_conversations", "g1_active_path", "g5_branches", "g6_conversation_detail", "g7_all_paths", "j7_attachment_kinds",
    "j8_roles", "o2_filtered_page", "o2_all_pages", "t5_search_matches", "t7_snippets", "t8_search_page",
    "e1_markdown_documents", "e2_plain_documents", "a6_structure_report", "x5_path_rules", "x8_contents_once", "x11_report",
    "x14_stream_scan", "s5_array_scan", "s6_salvaged_records", "i1_current_shards", "u4_snapshot_changes",
)
# The published scale profiles.
PROFILE_CONVERSATIONS = 10_000
LARGE_CONVERSATIONS, LARGE_REPLY_BYTES = 8_100, 64 * 1024


def run(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def timed(body) -> tuple[float, object]:
    began = time.time()
    out = body()
    return time.time() - began, out


def table_times(spark: SparkSession, folder: str) -> dict[str, float]:
    times = {}
    times["ingest"], archive = timed(
        lambda: build_archive(tables.archive_records(spark, folder), tables.attachment_files(spark, folder))
    )
    archive_queries._ARCHIVES[(spark.sparkContext.applicationId, folder)] = archive
    times["links"] = timed(lambda: archive.links)[0]
    times["attachments"] = timed(lambda: archive.attachments)[0]
    times["postings"] = timed(lambda: archive.postings)[0]
    queries = registry.queries()
    for name in HEADLINE:
        times[name] = timed(lambda name=name: run(queries[name](spark, folder)))[0]
    return times


def write_export(spark: SparkSession, n: int, reply: str, per_shard: int, attachment: bool = False) -> str:
    """An export folder of synthetic conversations: one question and one reply each."""
    root = tempfile.mkdtemp(prefix="export-", dir="/tmp")
    file = F.struct(F.format_string("file-%d", "id").alias("id"), F.lit("p.png").alias("name"))
    metadata = F.when(F.lit(attachment), F.struct(F.array(file).alias("attachments")))

    def message(role: str, text):
        content = F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts"))
        return F.struct(
            F.lit(role[0]).alias("id"), F.struct(F.lit(role).alias("role")).alias("author"),
            (F.col("id") + 4102444800.0).alias("create_time"), content.alias("content"), metadata.alias("metadata"),
        )

    text = F.concat(F.lit(reply), F.lit(" "), F.col("id").cast("string"))
    a = F.struct(F.lit("a").alias("id"), F.lit(None).cast("string").alias("parent"), F.array(F.lit("b")).alias("children"),
                 message("user", F.lit("Synthetic question")).alias("message"))
    b = F.struct(F.lit("b").alias("id"), F.lit("a").alias("parent"), F.array().cast("array<string>").alias("children"),
                 message("assistant", text).alias("message"))
    nodes = F.struct(a.alias("a")) if attachment else F.struct(a.alias("a"), b.alias("b"))
    record = F.to_json(
        F.struct(
            F.format_string("c%d", "id").alias("id"), F.format_string("Synthetic %d", "id").alias("title"),
            (F.col("id") + 4102444800.0).alias("create_time"), nodes.alias("mapping"),
            F.lit("a" if attachment else "b").alias("current_node"),
        )
    )
    rows = spark.range(n).repartition(8).select((F.col("id") / per_shard).cast("int").alias("shard"), record.alias("r"))
    for shard in range(-(-n // per_shard)):
        with open(f"{root}/conversations-{shard:03}.json", "w", encoding="utf8") as out:
            out.write("[")
            for i, row in enumerate(rows.where(F.col("shard") == shard).toLocalIterator()):
                out.write(("," if i else "") + row.r)
            out.write("]")
    if attachment:
        header = bytes.fromhex("89504E470D0A1A0A0000000D494844520000000100000001")
        for i in range(n):
            with open(f"{root}/file-{i}.dat", "wb") as out:
                out.write(header)
    return root


def one_shard(root: str) -> str:
    """The shards of an export as a single one."""
    target = tempfile.mkdtemp(prefix="export-", dir="/tmp")
    with open(f"{target}/conversations.json", "w", encoding="utf8") as out:
        for i, name in enumerate(sorted(os.listdir(root))):
            with open(f"{root}/{name}", encoding="utf8") as part:
                out.write(("," if i else "[") + part.read()[1:-1])
        out.write("]")
    return target


def ingest_export(spark: SparkSession, root: str, with_files: bool) -> Archive:
    found = listing.shards_in(listing.list_files(spark, root))
    table, _ = ingest_shards(spark, found, scratch_path(spark, "archive"))
    if not with_files:
        return Archive(table, None)
    named = listing.attachments_in(listing.binary_files(spark, root))
    archive = Archive(table, materialize(A.classify_files(named), "files"))
    archive.attachments  # noqa: B018
    return archive


def profile_times(spark: SparkSession) -> dict[str, float]:
    times = {}
    small = write_export(spark, PROFILE_CONVERSATIONS, "Synthetic searchable token reply", 2_500)
    ingest_export(spark, small, False)
    times["profile_ingest_10k"], archive = timed(lambda: ingest_export(spark, small, False))
    times["profile_index_10k"] = timed(lambda: archive.postings)[0]
    asked = ConversationQuery(search="Synthetic searchable token", role="assistant", page_size=100)
    found = []
    for _ in range(3):
        found.append(timed(lambda: archive.list_conversations(asked)[0].collect())[0])
    times["profile_search_10k"] = min(found)
    files = write_export(spark, PROFILE_CONVERSATIONS, "x", 2_500, attachment=True)
    times["profile_ingest_10k_files"] = timed(lambda: ingest_export(spark, files, True))[0]
    reply = "Synthetic text " * (LARGE_REPLY_BYTES // 15)
    large = write_export(spark, LARGE_CONVERSATIONS, reply, 450)
    times["profile_ingest_500mb"] = timed(lambda: ingest_export(spark, large, False))[0]
    single = one_shard(large)
    times["profile_ingest_500mb_one_shard"] = timed(lambda: ingest_export(spark, single, False))[0]
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "zstd").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder), "sf0.001")
    if os.path.isdir(warm) and warm != folder:
        table_times(spark, warm)
    times = table_times(spark, folder)
    if os.environ.get("BENCH_PROFILE", "full") == "full":
        times |= profile_times(spark)
    line = {
        "metric": "archive_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()}, "sf": folder.rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
