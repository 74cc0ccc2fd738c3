"""Sizes of what is shown, domains and table columns of the archive."""

from __future__ import annotations

# The nesting that is read, and sizes of what is shown.
MAX_NESTING_DEPTH = 256
MAX_TITLE_BYTES = 8 * 1024
MAX_FILENAME_BYTES = 1_024
MAX_MIME_BYTES = 256
MAX_CONTENT_TYPE_BYTES = 128
MAX_MARKER_BYTES = 16 * 1024
MAX_NAME_BYTES = 240
BRANCH_PREVIEW_CHARS = 180
DEFAULT_PAGE_SIZE = 50
SNIPPET_TOKENS = 18
SIGNATURE_BYTES = 64 * 1024
MAX_TEXT_PREVIEW_BYTES = 2 * 1024 * 1024
MAX_INLINE_MEDIA_BYTES = 64 * 1024 * 1024
MAX_DOWNLOAD_BYTES = 16 * 1024 * 1024 * 1024
MAX_IMAGE_SIDE = 8_192
MAX_IMAGE_PIXELS = 16_777_216
MAX_STEM_BYTES = 96

# Domains.
ROLES = ("user", "assistant", "system", "tool", "other")
ATTACHMENT_KINDS = ("image", "audio", "video", "pdf", "text", "other", "missing")
DEFAULT_TITLE = "Untitled conversation"

# The projection version: stored with the manifest, a change re-reads every shard.
PROJECTION_VERSION = "1"

# Columns of the relational views over the archive.
CONVERSATION_COLUMNS = (
    "conversation_key", "shard_name", "shard_ordinal", "title", "created_at", "updated_at",
    "archived", "starred", "current_node", "message_count", "has_attachments",
)
NODE_COLUMNS = (
    "conversation_key", "node_id", "parent_node_id", "message_id", "role", "created_at",
    "content_type", "message_text", "has_attachments",
)
ATTACHMENT_COLUMNS = (
    "attachment_key", "conversation_key", "node_id", "ordinal", "display_name", "source_name",
    "claimed_mime", "detected_mime", "byte_size", "status", "preview_kind",
)
