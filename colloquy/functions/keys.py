"""Opaque keys: 32 hex digits of a domain-separated SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def opaque_key(domain: str, *parts: Column) -> Column:
    """Null parts are left out, as ``concat_ws`` does."""
    text = F.concat_ws(SEPARATOR, F.lit(domain), *[p.cast("string") for p in parts])
    return F.left(F.sha2(text, 256), F.lit(32))


def conversation_key(shard: Column, ordinal: Column, source_id: Column) -> Column:
    return opaque_key("conversation-v1", shard, ordinal, source_id)


def node_key(conversation: Column, raw_id: Column) -> Column:
    return F.when(raw_id.isNotNull(), opaque_key("node-v1", conversation, raw_id))


def message_key(conversation: Column, raw_id: Column) -> Column:
    return F.when(raw_id.isNotNull(), opaque_key("message-v1", conversation, raw_id))


def attachment_key(conversation: Column, node: Column, ordinal: Column) -> Column:
    return opaque_key("attachment-v1", conversation, node, ordinal)


def path_digest(target: Column, domain: str = "repository-path-v1") -> Column:
    """Opaque 16-digit digest of a path; the domain tag ends with a zero byte."""
    return F.left(F.sha2(F.concat(F.lit(domain), F.lit("\x00"), target), 256), F.lit(16))
