"""Attachment files: classification, matching to references, names, checks.

File bytes are read once, in the narrow classification step; only its small result
is joined.  Matching is an equi-join on candidate names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schemas as S
from colloquy.functions import images
from colloquy.functions.text import (
    CONTROL, ascii_lower, let, trim_ws,
)

# Fixed values: (offset, leading bytes in hex, MIME type, extension).  First match wins.
SIGNATURES = (
    (0, "89504E470D0A1A0A", "image/png", "png"),
    (0, "FFD8FF", "image/jpeg", "jpg"),
    (0, "474946", "image/gif", "gif"),
    (8, "57454250", "image/webp", "webp"),
    (0, "49492A00", "image/tiff", "tif"),
    (0, "4D4D002A", "image/tiff", "tif"),
    (0, "424D", "image/bmp", "bmp"),
    (4, "66747970617669", "image/avif", "avif"),
    (4, "6674797068656963", "image/heif", "heif"),
    (4, "667479704D3441", "audio/m4a", "m4a"),
    (4, "667479707174", "video/quicktime", "mov"),
    (4, "6674797069736F", "video/mp4", "mp4"),
    (4, "667479706D703431", "video/mp4", "mp4"),
    (4, "667479706D703432", "video/mp4", "mp4"),
    (4, "6674797061766331", "video/mp4", "mp4"),
    (4, "6674797064617368", "video/mp4", "mp4"),
    (0, "1A45DFA3", "video/webm", "webm"),
    (0, "000001B3", "video/mpeg", "mpg"),
    (0, "000001BA", "video/mpeg", "mpg"),
    (8, "57415645", "audio/x-wav", "wav"),
    (8, "41564920", "video/x-msvideo", "avi"),
    (0, "4D546864", "audio/midi", "midi"),
    (0, "494433", "audio/mpeg", "mp3"),
    (0, "FFFB", "audio/mpeg", "mp3"),
    (0, "FFF3", "audio/mpeg", "mp3"),
    (0, "FFF2", "audio/mpeg", "mp3"),
    (0, "4F676753", "audio/ogg", "ogg"),
    (0, "664C6143", "audio/x-flac", "flac"),
    (0, "2321414D52", "audio/amr", "amr"),
    (0, "FFF1", "audio/aac", "aac"),
    (0, "FFF9", "audio/aac", "aac"),
    (8, "41494646", "audio/x-aiff", "aiff"),
    (0, "25504446", "application/pdf", "pdf"),
    (0, "504B0304", "application/zip", "zip"),
    (0, "504B0506", "application/zip", "zip"),
    (0, "1F8B08", "application/gzip", "gz"),
    (0, "377ABCAF271C", "application/x-7z-compressed", "7z"),
    (0, "526172211A07", "application/vnd.rar", "rar"),
)
RIFF_TYPES = ("57415645", "41564920")

# Extension by MIME type, used when the detected extension is unknown.
MIME_EXTENSIONS = {
    "image/jpeg": "jpg", "image/png": "png", "audio/aac": "aac", "audio/flac": "flac",
    "audio/m4a": "m4a", "audio/mp4": "m4a", "audio/x-m4a": "m4a", "audio/mpeg": "mp3",
    "audio/ogg": "ogg", "audio/wav": "wav", "audio/x-wav": "wav", "audio/webm": "webm",
    "video/mp4": "mp4", "video/mpeg": "mpeg", "video/ogg": "ogv", "video/quicktime": "mov",
    "video/webm": "webm", "application/pdf": "pdf", "application/zip": "zip", "text/plain": "txt",
}
TEXT_EXTENSIONS = (
    "txt", "md", "markdown", "csv", "tsv", "json", "jsonl", "yaml", "yml", "toml", "log", "rst",
)
EXTENSION_SYNONYMS = (
    ("jpg", "jpeg"), ("tif", "tiff"), ("midi", "mid"), ("aiff", "aif"), ("mpg", "mpeg"),
    ("mpeg", "mpg"), ("ogv", "ogg"),
)
GENERIC_STEMS = ("attachment", "file", "download", "untitled")
PREVIEW_VIDEO = ("video/mp4", "video/webm", "video/quicktime", "video/mpeg")
DEVICE_NAMES = r"(?i:CON|PRN|AUX|NUL|(?:COM|LPT)[1-9])"
# MIME types a viewer may show, and the size limit of a shown PDF.
SAFE_PREVIEW = {
    "image": ("image/jpeg", "image/png"),
    "audio": (
        "audio/aac", "audio/flac", "audio/m4a", "audio/mp4", "audio/mpeg", "audio/ogg", "audio/wav",
        "audio/webm", "audio/x-flac", "audio/x-m4a", "audio/x-wav",
    ),
    "video": ("video/mp4", "video/mpeg", "video/ogg", "video/quicktime", "video/webm"),
    "pdf": ("application/pdf",),
}
MAX_PDF_PREVIEW_BYTES = 20 * 1024 * 1024


# ------------------------------------------------------------ classification


def whole_characters(prefix: Column) -> Column:
    """The bytes without a last character that the end of the prefix cuts."""
    last = F.hex(F.substring(prefix, -3, 3))
    # A lead byte of 2, 3 or 4 with fewer bytes after it than it asks for.
    cut = F.length(F.regexp_extract(last, r"(?:[CDEF].|[EF].[89AB].|F.[89AB].[89AB].)$", 0)) / 2
    return F.substring(prefix, F.lit(1), (F.octet_length(prefix) - cut).cast("int"))


def looks_like_text(prefix: Column) -> Column:
    """Valid UTF-8, no NUL, control bytes at most one in twenty."""
    as_text = prefix.cast("string")
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
    size = F.octet_length(prefix)
    # Each is one byte.  Few files have any, so one search decides nearly all.
    kept = F.octet_length(F.regexp_replace(as_text, control, ""))
    few = ~as_text.rlike(control) | ((size - kept) * 20 <= size)
    return F.is_valid_utf8(as_text) & ~as_text.contains("\x00") & few


def _signature(prefix: Column, pick: int) -> Column:
    head = F.hex(F.substring(prefix, 1, 16))
    tests = None
    for offset, magic, mime, extension in SIGNATURES:
        hit = F.substring(head, 2 * offset + 1, len(magic)) == magic
        if magic in RIFF_TYPES:
            hit = hit & F.startswith(head, F.lit("52494646"))
        if magic == "41494646":
            hit = hit & F.startswith(head, F.lit("464F524D"))
        value = F.lit((mime, extension)[pick])
        tests = F.when(hit, value) if tests is None else tests.when(hit, value)
    return tests


def classify_files(files: DataFrame) -> DataFrame:
    """``(path, length, content)`` to MIME type, extension and preview kind.

    Only the first 64 KiB decide.
    """
    return classify_prefixes(files.select(
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"),
        F.col("length").alias("byte_size"),
        F.when(F.col("length") <= S.MAX_DOWNLOAD_BYTES, F.substring("content", 1, S.SIGNATURE_BYTES)).alias("prefix"),
    ))


def classify_prefixes(files: DataFrame) -> DataFrame:
    """``(name, byte_size, prefix)`` to MIME type, extension and preview kind.

    A null prefix is that of a file too large to be opened, which has no type.
    """
    rows = (
        files.select("name", "byte_size", "prefix")
        .withColumn("mime", _signature(F.col("prefix"), 0))
        .withColumn("ext", _signature(F.col("prefix"), 1))
        .withColumn("is_text", F.when(F.col("mime").isNull(), looks_like_text(
            F.when(F.col("byte_size") > S.SIGNATURE_BYTES, whole_characters(F.col("prefix"))).otherwise(F.col("prefix")))))
        # Python sees the bytes of JPEG files only.
        .withColumn("jpeg", images.jpeg_dimensions(F.when(F.col("mime") == "image/jpeg", F.col("prefix"))))
        .withColumn("png", F.when(F.col("mime") == "image/png", images.png_dimensions(F.col("prefix"))))
    )
    width, height = F.coalesce("png.width", "jpeg.width"), F.coalesce("png.height", "jpeg.height")
    side = S.MAX_IMAGE_SIDE
    fits = width.between(1, side) & height.between(1, side) & (width * height <= S.MAX_IMAGE_PIXELS)
    mime = F.coalesce(F.col("mime"), F.when(F.col("is_text"), "text/plain"))
    kind = (
        F.when(F.col("mime").isin("image/png", "image/jpeg") & F.coalesce(fits, F.lit(False)), "image")
        .when(F.col("mime").startswith("audio/"), "audio")
        .when(F.col("mime").isin(*PREVIEW_VIDEO), "video")
        .when(F.col("mime") == "application/pdf", "pdf")
        .when(F.col("is_text"), "text")
        .otherwise("unsupported")
    )
    keeps_extension = mime.rlike(r"^(?:image|audio|video)/|^application/(?:pdf|zip)\z")
    return rows.select(
        "name",
        "byte_size",
        mime.alias("detected_mime"),
        F.when(F.col("is_text"), "txt").when(keeps_extension, F.col("ext")).alias("detected_extension"),
        bounded_kind(kind, F.col("byte_size")).alias("preview_kind"),
        width.alias("width"),
        height.alias("height"),
    )


def bounded_kind(kind: Column, size: Column) -> Column:
    too_big = ((kind != "text") & (size > S.MAX_INLINE_MEDIA_BYTES)) | (
        (kind == "text") & (size > S.MAX_TEXT_PREVIEW_BYTES)
    )
    return F.when(too_big, "unsupported").otherwise(kind)


def read_text_files(files: DataFrame) -> DataFrame:
    """Whole text of files that look like text."""
    return files.where(looks_like_text(F.col("content"))).select(
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"),
        F.decode("content", "utf-8").alias("text"),
    )


# ------------------------------------------------------------------ matching


def is_safe_component(c: Column) -> Column:
    odd = "/\\\\:⁄∕⧵／＼"
    stem = F.regexp_replace(F.substring_index(c, ".", 1), "[ .]+$", "")
    return (
        (c != "") & ~c.isin(".", "..") & ~c.rlike(f"[{CONTROL}{odd}]") & ~c.rlike(r"[ .]\z")
        & ~stem.rlike(rf"^{DEVICE_NAMES}\z")
    )


def candidate_names(value: Column) -> Column:
    """File names a reference may stand for, most likely first."""

    def variants(base: Column) -> Column:
        prefixed = base.startswith("file-") | base.startswith("file_")
        dated = ascii_lower(base).endswith(".dat")
        names = F.array(
            base,
            F.when(~dated, F.concat(base, F.lit(".dat"))),
            F.when(~prefixed, F.concat(F.lit("file-"), base, F.lit(".dat"))),
            F.when(~prefixed, F.concat(F.lit("file_"), base, F.lit(".dat"))),
        )
        return F.filter(F.array_compact(names), lambda n: (base != "") & is_safe_component(n))

    without_query = trim_ws(F.regexp_extract(value, r"^([^?#]*)", 1))
    base = F.regexp_extract(without_query, r"([^/\\:]*)\z", 1)
    base = F.regexp_replace(base, f"[{CONTROL}]", "")
    return let(base, lambda b: F.when(b.isNotNull(), variants(b)).otherwise(F.array().cast("array<string>")))


def unique_casefold(files: DataFrame) -> DataFrame:
    """Lower-cased names that stand for exactly one file; ambiguous ones are left out."""
    return (
        files.groupBy(ascii_lower(F.col("name")).alias("folded"))
        .agg(F.count("*").alias("n"), F.min("name").alias("name"))
        .where("n = 1")
        .drop("n")
    )


def match_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``(attachment_key, source_name)``: exact name first, then a unique case-folded one.

    The candidates of a reference are tried in order.  The lookup side has one row
    per name, so a frequent candidate (many files called "Attachment") meets at most
    one row; adaptive skew-join splitting spreads such a key over tasks.
    """
    tries = refs.select(
        "attachment_key",
        F.posexplode(
            F.array_distinct(
                F.concat(candidate_names(F.col("reference")), candidate_names(F.col("display_name")))
            )
        ).alias("rank", "candidate"),
    )
    lookups = tries.select(
        "attachment_key",
        F.explode(
            F.array(
                F.struct((F.col("rank") * 2).alias("rank"), F.concat(F.lit("="), "candidate").alias("probe")),
                F.struct(
                    (F.col("rank") * 2 + 1).alias("rank"),
                    F.concat(F.lit("~"), ascii_lower(F.col("candidate"))).alias("probe"),
                ),
            )
        ).alias("t"),
    ).select("attachment_key", "t.rank", "t.probe")
    index = files.select(F.concat(F.lit("="), "name").alias("probe"), F.col("name").alias("source_name")).unionByName(
        unique_casefold(files).select(
            F.concat(F.lit("~"), "folded").alias("probe"), F.col("name").alias("source_name")
        )
    )
    hits = lookups.join(index, "probe")
    return hits.groupBy("attachment_key").agg(F.min_by("source_name", "rank").alias("source_name"))


# -------------------------------------------------------------------- naming


def category(mime: Column, kind: Column) -> Column:
    return (
        F.when(mime.startswith("image/"), "Image")
        .when(mime.startswith("audio/"), "Audio")
        .when(mime.startswith("video/"), "Video")
        .when(mime.startswith("text/"), "Text")
        .when(mime == "application/pdf", "PDF")
        .when(mime == "application/zip", "Archive")
        .when(kind == "pdf", "PDF")
        .when(kind == "unsupported", "File")
        .otherwise(F.initcap(kind))
    )


def _extension_fits(current: Column, mime: Column, detected: Column) -> Column:
    low = ascii_lower(current)
    found = ascii_lower(detected)
    pairs = F.array(*[F.lit(f"{a}/{b}") for a, b in EXTENSION_SYNONYMS])
    by_mime = F.create_map(*[F.lit(x) for item in MIME_EXTENSIONS.items() for x in item])
    default = F.try_element_at(by_mime, mime)
    return (
        F.when(F.coalesce(mime.startswith("text/"), F.lit(False)), low.isin(*TEXT_EXTENSIONS))
        .when(
            found.isNotNull(),
            (low == found) | F.array_contains(pairs, F.concat(found, F.lit("/"), low)),
        )
        .otherwise(
            F.coalesce(
                (low == default) | F.array_contains(pairs, F.concat(default, F.lit("/"), low)), F.lit(False)
            )
        )
    )


def attachment_name(value: Column, mime: Column, extension: Column, kind: Column, ordinal: Column | None) -> Column:
    """A safe file name: generic stems are replaced, the extension is repaired."""
    by_mime = F.create_map(*[F.lit(x) for item in MIME_EXTENSIONS.items() for x in item])
    safe = F.translate(F.regexp_replace(value, f"[{CONTROL}]", ""), '/\\:"', "____")
    pattern = r"(?s)^(.+)\.([A-Za-z0-9]{1,16})\z"

    def build(trimmed: Column) -> Column:
        has = trimmed.rlike(pattern)
        stem = F.when(has, F.regexp_extract(trimmed, pattern, 1)).otherwise(trimmed)
        current = F.when(has, F.regexp_extract(trimmed, pattern, 2))
        generic = (stem == "") | ascii_lower(stem).isin(*GENERIC_STEMS)
        label = F.concat(category(mime, kind), F.lit(" attachment"))
        if ordinal is not None:
            label = F.concat(label, F.lit(" "), (ordinal + 1).cast("string"))
        named = F.when(generic, label).otherwise(stem)
        keep = (ascii_lower(current) != "dat") & _extension_fits(current, mime, extension)
        usable = F.when(extension.rlike(r"^[A-Za-z0-9]{1,16}\z"), extension)
        ending = F.coalesce(
            F.when(keep, current), usable, F.try_element_at(by_mime, mime), F.lit("bin")
        )
        return F.struct(named.alias("stem"), ending.alias("ending"))

    def bound(part: Column) -> Column:
        room = F.lit(S.MAX_NAME_BYTES - 1) - F.octet_length(part["ending"])
        cut = F.when(F.octet_length(part["stem"]) <= room, part["stem"]).otherwise(
            _cut_to(part["stem"], room)
        )
        clean = F.regexp_replace(cut, "^[ .]+|[ .]+$", "")
        return F.concat(
            F.when(clean == "", F.lit("Attachment")).otherwise(clean), F.lit("."), part["ending"]
        )

    return let(let(F.regexp_replace(safe, "^[ .]+|[ .]+$", ""), build), bound)


def _cut_to(c: Column, room: Column) -> Column:
    raw = c.cast("binary")
    return F.coalesce(
        *[F.try_validate_utf8(F.substring(raw, F.lit(1), room - back).cast("string")) for back in range(4)]
    )


# ---------------------------------------------------------------- resolution


def resolve_attachments(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References joined with their classified file: status, size, kind and name."""
    matched = refs.join(match_files(refs, files), "attachment_key", "left").join(
        files.withColumnRenamed("name", "source_name"), "source_name", "left"
    )
    refused = F.col("byte_size") > S.MAX_DOWNLOAD_BYTES
    status = (
        F.when(F.col("source_name").isNull(), "missing").when(refused, "rejected").otherwise("available")
    )
    kind = (
        F.when(F.col("status") == "missing", "missing")
        .when(F.col("status") == "rejected", "unsupported")
        .otherwise(F.col("preview_kind"))
    )
    ok = F.col("status") == "available"
    mime = F.when(ok, F.col("detected_mime"))
    extension = F.when(ok, F.col("detected_extension"))
    return matched.withColumn("status", status).select(
        "attachment_key",
        "conversation_key",
        "node_id",
        "ordinal",
        attachment_name(F.col("display_name"), mime, extension, kind, F.col("ordinal")).alias("display_name"),
        F.when(ok, F.col("source_name")).alias("source_name"),
        "claimed_mime",
        mime.alias("detected_mime"),
        "byte_size",
        "status",
        kind.alias("preview_kind"),
    )


def type_mismatches(attachments: DataFrame) -> DataFrame:
    """Available files whose content is not what the reference claims."""
    return attachments.where(
        F.col("claimed_mime").isNotNull()
        & F.col("detected_mime").isNotNull()
        & (F.col("claimed_mime") != F.col("detected_mime"))
    ).select("attachment_key", "display_name", "claimed_mime", "detected_mime")


def preview_eligible(attachments: DataFrame) -> DataFrame:
    """Attachments a viewer may show: allowed type for their kind, bounded size."""
    kind = F.col("preview_kind")
    mime = F.substring_index(ascii_lower(F.col("detected_mime")), ";", 1)
    allowed = kind == "text"
    for name, mimes in SAFE_PREVIEW.items():
        limit = MAX_PDF_PREVIEW_BYTES if name == "pdf" else S.MAX_INLINE_MEDIA_BYTES
        allowed = allowed | ((kind == name) & mime.isin(*mimes) & (F.col("byte_size") <= limit))
    return attachments.where((F.col("status") == "available") & allowed).select(
        "attachment_key", "preview_kind", "detected_mime", "byte_size"
    )


def attachment_records(attachments: DataFrame) -> DataFrame:
    """Attachments that can be opened."""
    return attachments.where(
        (F.col("status") == "available") & F.col("source_name").isNotNull() & F.col("byte_size").isNotNull()
    ).select("attachment_key", "display_name", "source_name", "detected_mime", "byte_size", "preview_kind")


def changed_files(attachments: DataFrame, files_now: DataFrame) -> DataFrame:
    """Stored attachments whose file is gone or now has another size, type or kind."""
    now = files_now.select(
        F.col("name").alias("source_name"),
        F.col("byte_size").alias("now_size"),
        F.col("detected_mime").alias("now_mime"),
        F.col("preview_kind").alias("now_kind"),
    )
    joined = attachments.where("status = 'available'").join(now, "source_name", "left")
    same = (
        F.col("byte_size").eqNullSafe(F.col("now_size"))
        & F.col("detected_mime").eqNullSafe(F.col("now_mime"))
        & F.col("preview_kind").eqNullSafe(F.col("now_kind"))
    )
    return joined.where(~same).select(
        "attachment_key", "source_name", "byte_size", "now_size", "preview_kind", "now_kind"
    )


__all__ = [
    "attachment_name", "attachment_records", "bounded_kind", "candidate_names", "changed_files",
    "classify_files", "classify_prefixes", "match_files", "preview_eligible",
    "read_text_files", "resolve_attachments", "type_mismatches", "unique_casefold",
]
