"""The text scan on rows as they arrive: stateless, findings are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions.keys import path_digest
from colloquy.functions.rules import content_rules


def scan_stream(rows: DataFrame, text: str, target: Column) -> DataFrame:
    """Same rules as the batch scan; a text row yields each rule at most once."""
    return rows.select(F.explode(content_rules(F.col(text))).alias("rule_id"), path_digest(target).alias("digest"))


def write_findings(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        found.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
