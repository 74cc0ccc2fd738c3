"""Search text: case and diacritics folded, cut into words, without leaving the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# A word of the unfolded text with whatever follows it up to the next word.
PIECE = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:[^\p{L}\p{N}]*)"


@cache
def _strip_table() -> tuple[str, str]:
    """Lower-case letters with marks and their base letter, from the Unicode data.

    Marks that stand alone come last and have no counterpart, so they are dropped.
    """
    marked, bases, alone = [], [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn" and unicodedata.combining(ch):
            alone.append(ch)
            continue
        parts = unicodedata.normalize("NFD", ch)
        rest = parts[1:]
        if rest and ch == ch.lower() and all(unicodedata.combining(m) for m in rest):
            marked.append(ch)
            bases.append(parts[0])
    return "".join(marked + alone), "".join(bases)


def fold(c: Column) -> Column:
    source, target = _strip_table()
    low = F.lower(c)
    # Most texts of many languages are plain ASCII; they skip the table.
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, source, target)).otherwise(low)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
