"""String expressions.  Every function takes and returns a ``Column``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import schemas as S

# Unicode White_Space, spelled out because \s means something else in every engine.
WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"\x{00}-\x{1F}\x{7F}-\x{9F}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{WS}]")


def byte_truncate(c: Column, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` bytes that ends on a character."""

    def cut(v: Column) -> Column:
        raw = v.cast("binary")
        cuts = [
            F.try_validate_utf8(F.substring(raw, 1, max_bytes - back).cast("string"))
            for back in range(4)
        ]
        return F.when(F.octet_length(v) <= max_bytes, v).when(v.isNotNull(), F.coalesce(*cuts))

    return let(c, cut)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize_role(c: Column) -> Column:
    return let(
        ascii_lower(c), lambda low: F.when(low.isin(*S.ROLES), low).otherwise(F.lit("other"))
    )


def clean_title(c: Column) -> Column:
    return let(
        byte_truncate(c, S.MAX_TITLE_BYTES),
        lambda cut: F.when(~is_blank(cut), cut).otherwise(F.lit(S.DEFAULT_TITLE)),
    )


def clean_display_name(c: Column) -> Column:
    safe = F.translate(F.regexp_replace(c, f"[{CONTROL}]", ""), "/\\:", "___")
    return let(
        byte_truncate(trim_ws(safe), S.MAX_NAME_BYTES),
        lambda cut: F.when(cut == "", F.lit("Attachment")).otherwise(cut),
    )


def clean_mime(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9/+.-]", ""), 1, S.MAX_MIME_BYTES)


# Private-use marker envelope and the kinds that are removed.
MARKER_OPEN, MARKER_CLOSE, MARKER_SEPARATOR = "\ue200", "\ue201", "\ue202"
MARKER_KINDS = ("cite", "navlist", "filecite")


def strip_markers(c: Column) -> Column:
    """Drop well-formed, known, bounded markers; leave any other one as it is.

    Cutting at each opening character leaves segments that can hold at most one
    payload, so the byte bound of a payload is tested exactly.
    """
    head = f"^(?:{'|'.join(MARKER_KINDS)}){MARKER_SEPARATOR}"
    body = f"([^{MARKER_CLOSE}]+){MARKER_CLOSE}"

    def segment(s: Column) -> Column:
        size = F.octet_length(F.regexp_extract(s, head + body, 1))
        return F.when(
            size.between(1, S.MAX_MARKER_BYTES), F.regexp_replace(s, head + body, "")
        ).otherwise(F.concat(F.lit(MARKER_OPEN), s))

    def rebuild(parts: Column) -> Column:
        marked = F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(segment(s)))
        return F.array_join(marked, "")

    def strip(v: Column) -> Column:
        return F.when(v.contains(MARKER_OPEN), rebuild(F.split(v, MARKER_OPEN, -1))).otherwise(v)

    return let(c, strip)


def collapse_whitespace(c: Column) -> Column:
    spaced = F.regexp_replace(c, f"[{WS}{CONTROL}]+", " ")
    return F.regexp_replace(spaced, "^ | $", "")


def is_opaque_identifier(c: Column) -> Column:
    return c.rlike(
        r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}"
        r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\z"
    )


def is_opaque_key(c: Column) -> Column:
    return c.rlike(r"^[0-9a-fA-F]{32}\z")


def display_title(c: Column) -> Column:
    return let(
        collapse_whitespace(c),
        lambda v: F.when((v == "") | is_opaque_identifier(v), F.lit(S.DEFAULT_TITLE)).otherwise(v),
    )


def display_role(c: Column) -> Column:
    def name(v: Column) -> Column:
        low = ascii_lower(v)
        return (
            F.when((v == "") | is_opaque_identifier(v), F.lit("Other"))
            .when(low.isin("assistant", "system", "tool", "user"), F.initcap(low))
            .otherwise(v)
        )

    return let(collapse_whitespace(c), name)


def markdown_inline(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]<>#|!])", r"\\$1")


def encode_controls(c: Column) -> Column:
    """CR and CRLF become LF; other control characters become ``[U+XXXX]``."""
    active = f"[{CONTROL}&&[^\\t\\n]]"
    codes = [n for n in [*range(0x20), *range(0x7F, 0xA0)] if n not in (9, 10, 13)]
    names = F.create_map(*[x for n in codes for x in (F.lit(chr(n)), F.lit(f"[U+{n:04X}]"))])

    def encode(v: Column) -> Column:
        seen = F.array_distinct(F.regexp_extract_all(v, F.lit(active), F.lit(0)))
        encoded = F.aggregate(seen, v, lambda acc, ch: F.replace(acc, ch, F.element_at(names, ch)))
        return F.when(v.rlike(active), encoded).otherwise(v)

    return let(F.regexp_replace(c, "\r\n?", "\n"), encode)


def plain_seconds(c: Column) -> Column:
    """Epoch seconds without an exponent and without trailing zeros."""
    text = c.cast("decimal(38,9)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def export_file_name(title: Column, extension: str) -> Column:
    """File name of an exported document, safe on every common file system."""

    def stem(v: Column) -> Column:
        runs = F.regexp_replace(v, r"[^\p{IsAlphabetic}\p{N}]+", "-")
        cut = byte_truncate(F.regexp_replace(runs, "^-|-$", ""), S.MAX_STEM_BYTES)
        return F.when(is_opaque_identifier(v), F.lit("")).otherwise(F.regexp_replace(cut, "-$", ""))

    def named(v: Column) -> Column:
        return (
            F.when(v == "", F.lit("Untitled-conversation"))
            .when(
                v.rlike(r"^(?i:CON|PRN|AUX|NUL|(?:COM|LPT)[1-9])\z"),
                F.concat(F.lit("Conversation-"), v),
            )
            .otherwise(v)
        )

    return F.concat(let(let(trim_ws(title), stem), named), F.lit("." + extension))
