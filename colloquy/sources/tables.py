"""Archive inputs derived from plain tables.

``conversations(conv_id, turn, role, text)`` becomes JSON records of the export
shape, and ``documents`` becomes the attachment files.  Branches, anomalies and
odd value types are added by arithmetic on the ids, so any engine can state the
expected tables directly from the same input.

In the fragments below ``c`` is the conversation, ``t`` the turn, ``mt`` the last
turn and ``d`` the document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import spread

OPEN, CLOSE, SEP = "\ue200", "\ue201", "\ue202"

NO_MESSAGE = "(t = 0 AND c % 12 = 3)"
ALIASED = "(c > 0 AND c % 31 = 0)"
DANGLING = "(c > 0 AND c % 11 = 0)"
CYCLIC = "(c > 0 AND c % 17 = 0 AND c % 11 <> 0 AND mt >= 1)"
STUB = "(c > 0 AND c % 29 = 0)"
PARENT = f"""CASE WHEN t = 0 THEN (CASE WHEN {CYCLIC} THEN 'n1' END)
  WHEN t = 1 AND {DANGLING} THEN 'missing'
  WHEN t = 1 AND {ALIASED} THEN 'k0'
  WHEN t % 3 = 0 THEN 'n' || (t - 2) ELSE 'n' || (t - 1) END"""
CREATED = "CASE WHEN (c + t) % 10 <> 9 THEN c * 1000e0 + t END"
MARKED = f"""text || CASE WHEN (c + 2 * t) % 7 = 3 THEN ' {OPEN}cite{SEP}turn0{CLOSE}'
  WHEN (c + 2 * t) % 7 = 4 THEN ' {OPEN}other{SEP}x{CLOSE}' ELSE '' END"""
RAW_ROLE = "CASE WHEN t % 4 = 1 THEN upper(role) WHEN c % 15 = 4 AND t = 2 THEN 'moderator' ELSE role END"
NAME = """CASE WHEN d % 4 = 0 THEN 'report ' || d || '.pdf' WHEN d % 4 = 1 THEN 'download'
  WHEN d % 4 = 2 THEN 'a/b:' || d || '.png' END"""
MIME = "CASE WHEN d % 5 = 0 THEN 'image/png' WHEN d % 5 = 1 THEN 'application/pdf; q=1' END"
POINTER = "(c + t) % 4 = 2 AND t = 1"
SHARD = "'conversations-' || lpad(CAST(c % 10 AS STRING), 3, '0') || '.json'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_ATTACHMENTS = f"""transform(docs, d -> named_struct(
  'id', if(d % 2 = 0, 'file-' || d, null),
  'asset_pointer', if(d % 2 = 1, 'file-service://file-' || d, null),
  'name', {NAME}, 'mime_type', {MIME}))"""

_CONTENT = f"""CASE (c + t) % 4
  WHEN 0 THEN to_variant_object(named_struct('content_type', 'text', 'parts', array(marked)))
  WHEN 1 THEN CAST(marked AS VARIANT)
  WHEN 2 THEN to_variant_object(named_struct('content_type', 'multimodal_text', 'parts',
    concat(array(CAST('' AS VARIANT), CAST(marked AS VARIANT),
                 parse_json('{{"text":"part two"}}'), parse_json('5')),
           if({POINTER}, array(to_variant_object(named_struct(
               'asset_pointer', 'sediment://file_' || c,
               'content_type', 'image_asset_pointer'))), array()))))
  ELSE to_variant_object(named_struct('text', marked, 'lang', 'x')) END"""

_CHILDREN = f"""concat(
  if(t = 1 AND {CYCLIC}, array(CAST('n0' AS VARIANT)), CAST(array() AS ARRAY<VARIANT>)),
  transform(filter(sequence(t + 1, t + 2),
      u -> u <= mt AND if(u % 3 = 0, u - 2, u - 1) = t AND NOT (u = 1 AND {DANGLING})),
    u -> CAST('n' || u AS VARIANT)),
  if(t = 0 AND c > 0 AND c % 19 = 0, array(CAST('lost' AS VARIANT)), CAST(array() AS ARRAY<VARIANT>)),
  if(t = 0 AND c > 0 AND c % 23 = 0, array(parse_json('7')), CAST(array() AS ARRAY<VARIANT>)))"""

_NODE = f"""named_struct(
  'id', 'n' || t, 'parent', {PARENT}, 'children', {_CHILDREN},
  'zone', if(c % 5 = 2 AND t % 2 = 1, 1, null),
  'message', if({NO_MESSAGE}, null, named_struct(
    'id', 'm' || t,
    'author', named_struct('role', {RAW_ROLE}, 'nick', if(c % 5 = 4, 'z', null)),
    'create_time', {CREATED},
    'content', {_CONTENT},
    'flag', if(c % 5 = 3, true, null),
    'metadata', if(t = 0 AND size(docs) > 0, named_struct('attachments', {_ATTACHMENTS}), null))))"""

_HEADER = f"""named_struct(
  'id', if(c % 8 = 3, null, 'c' || c), 'conversation_id', if(c % 8 = 3, 'c' || c, null),
  'title', CASE WHEN c % 9 = 0 THEN null WHEN c % 10 = 7 THEN '   ' ELSE title_text END,
  'create_time', c * 1000e0, 'update_time', if(c % 6 = 0, null, c * 1000e0 + mt),
  'is_archived', if(c % 5 = 1 OR c % 4 = 2, null, c % 5 = 0),
  'archived', if(c % 5 <> 1 AND c % 4 = 2, c % 5 = 0, null),
  'is_starred', if(c % 7 = 1, null, c % 7 = 0),
  'current_node', CASE WHEN c % 4 = 0 THEN null WHEN c % 13 = 0 THEN 'gone' ELSE 'n' || mt END,
  'x_note', if(c % 3 = 1, 1, null))"""


def archive_records(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard_name, shard_ordinal, record)`` built from the given tables."""
    turns = table(spark, folder, "conversations")
    docs = (
        table(spark, folder, "documents")
        .select(F.col("doc_id").alias("d"), F.expr("doc_id div 10").alias("conv_id"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("d")).alias("docs"))  # ten ids at most
    )
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    rows = (
        grouped.join(docs, "conv_id", "left")
        .withColumnRenamed("conv_id", "c")
        .withColumn("docs", F.coalesce("docs", F.array().cast("array<bigint>")))
        .withColumn("mt", F.size("turns").cast("bigint") - 1)
        .withColumn("title_text", F.col("turns")[0]["text"])
    )
    node = _NODE.replace("marked", f"({MARKED})")

    def lift(expr: str) -> str:
        # Bind the fragment's names to the fields of the lambda variable ``x``.
        out = re.sub(r"(?<![\w'.])t(?![\w'])", "x.turn", expr)
        out = re.sub(r"(?<![\w'_.])role(?![\w'])", "x.role", out)
        return re.sub(r"(?<![\w'_.])text(?![\w'])(?= \|\|)", "x.text", out)

    entry = f"""'"' || if({ALIASED} AND x.turn = 0, 'k0', 'n' || x.turn) || '":' || to_json({lift(node)})"""
    mapping = f"""'{{' || array_join(transform(turns, x -> {entry}), ',')
      || if({STUB}, ',"zz":"stub"', '') || '}}'"""
    header = f"to_json({_HEADER})"
    record = f"left({header}, length({header}) - 1) || ',\"mapping\":' || ({mapping}) || '}}'"
    record = f"""CASE WHEN c % 37 = 5 THEN '{{"id":"c' || c || '"}}'
      WHEN c % 37 = 6 THEN '{{"id":"c' || c || '","mapping":[1]}}'
      WHEN c % 37 = 7 THEN left({record}, length({record}) - 1) ELSE {record} END"""
    return rows.select(
        F.expr(SHARD).alias("shard_name"),
        F.expr("c div 10").alias("shard_ordinal"),
        F.expr(record).alias("record"),
    )


def attachment_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length, content)`` rows in the shape of the binary-file source: a file of every document.

    One in five has a name that no record refers to, so that some references miss their file.
    """
    docs = spread(table(spark, folder, "documents").selectExpr("doc_id AS d", "text"))
    magic = """CASE (d div 3) % 6
      WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || lpad(hex((d * 37) % 9000), 8, '0') || lpad(hex((d * 11) % 5000), 8, '0')
      WHEN 1 THEN 'FFD8FFE000104A46494600010100000100010000FFC0001108'
               || lpad(hex((d * 11) % 5000), 4, '0') || lpad(hex((d * 37) % 9000), 4, '0') || '03012200021101031101'
      WHEN 2 THEN '524946460000000057415645'
      WHEN 3 THEN '255044462D312E340A'
      WHEN 4 THEN ''
      ELSE '00010203' END"""
    content = f"concat(unhex({magic}), encode(text, 'utf-8'))"
    named = docs.select(
        F.explode(
            F.expr(
                """CASE WHEN d % 5 = 0 THEN array('file-spare-' || d || '.dat')
                   WHEN d % 7 = 1 AND d % 2 = 0 THEN array('FILE-' || d || '.DAT', 'File-' || d || '.dat')
                   WHEN d % 7 = 1 THEN array('FILE-' || d || '.DAT') ELSE array('file-' || d || '.dat') END"""
            )
        ).alias("name"),
        F.expr(content).alias("content"),
    )
    return named.select(
        F.concat(F.lit("export/"), "name").alias("path"),
        F.octet_length("content").cast("bigint").alias("length"),
        "content",
    )


EXPORT_SHARD_SIZE = 50


def write_export(spark: SparkSession, folder: str, target: str) -> None:
    """The records as an export folder: JSON array shards of fifty conversations each.

    A shard is one sorted partition written line by line, so nothing is put together in
    memory.  The writer chooses file names of its own, so the files are renamed after it.
    A record that does not parse is replaced by one that is broken inside, since a cut-off
    one would break its whole shard.
    """
    records = archive_records(spark, folder)
    number = F.col("shard_ordinal") * 10 + F.regexp_extract("shard_name", "([0-9]+)", 1).cast("bigint")
    shard = F.expr(f"n div {EXPORT_SHARD_SIZE}")
    text = F.when(F.try_parse_json("record").isNull(), F.lit('{"broken": tru}')).otherwise(F.col("record"))
    rows = records.select(number.alias("n"), text.alias("record")).select(
        shard.alias("shard"), (F.col("n") % EXPORT_SHARD_SIZE).alias("ordinal"), "record"
    )
    comma = F.when(F.col("ordinal") > 0, F.lit(",")).otherwise(F.lit("["))
    lines = rows.select("shard", "ordinal", F.concat(comma, "record").alias("value"))
    ends = rows.select("shard").distinct().select(
        "shard", F.lit(EXPORT_SHARD_SIZE).cast("bigint").alias("ordinal"), F.lit("]").alias("value")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.unionByName(ends).repartition(parts, "shard").sortWithinPartitions("shard", "ordinal").select(
        "shard", "value"
    ).write.partitionBy("shard").text(f"{target}-parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{target}-parts")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(target))
    for status in files.globStatus(hadoop.Path(f"{target}-parts/shard=*/part-*")):
        number = status.getPath().getParent().getName().split("=")[1]
        files.rename(status.getPath(), hadoop.Path(f"{target}/conversations-{number}.json"))
