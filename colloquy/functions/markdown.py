"""Neutralising message text for a Markdown document.

Code fences and code spans stay verbatim; elsewhere the characters that start active
syntax become entities.  Fence state runs from line to line, which expressions cannot
carry, so this is a small Arrow function; rows without any such character skip it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import encode_controls, let

# Entities of the characters that are neutralised.
ENTITIES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "[": "&#91;", "]": "&#93;"})
ACTIVE = r"[&<>\[\]]"

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.DOTALL)
_TICKS = re.compile(r"`+")


def neutral_line(line: str) -> str:
    """Entities outside code spans; a span closes with a run of equal length."""
    runs = list(_TICKS.finditer(line))
    out, at, i = [], 0, 0
    while i < len(runs):
        size = len(runs[i].group())
        close = next((j for j in range(i + 1, len(runs)) if len(runs[j].group()) == size), None)
        if close is None:
            out.append(line[at : runs[i].end()].translate(ENTITIES))
            at, i = runs[i].end(), i + 1
        else:
            out.append(line[at : runs[i].start()].translate(ENTITIES))
            out.append(line[runs[i].start() : runs[close].end()])
            at, i = runs[close].end(), close + 1
    out.append(line[at:].translate(ENTITIES))
    return "".join(out)


def neutral_text(text: str) -> str:
    lines, fence = [], None
    for line in text.split("\n"):
        found = _FENCE.fullmatch(line)
        if fence:
            lines.append(line)
            closes = found and found[1][0] == fence[0] and len(found[1]) >= len(fence)
            if closes and not found[2].strip(" \t"):
                fence = None
        elif found and not (found[1][0] == "`" and "`" in found[2]):
            lines.append(line)
            fence = found[1]
        else:
            lines.append(neutral_line(line))
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def _neutral(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else neutral_text(t))


def markdown_text(c: Column) -> Column:
    """Message text safe to place in a Markdown document.

    A lone carriage return is not a line end for the fence rules, so it becomes a line
    feed only after them; the one of CRLF goes before.
    """
    lines = F.regexp_replace(c, "\r\n", "\n")
    lines = F.regexp_replace(lines, "\r\\z", "")
    needs = F.when(lines.rlike(ACTIVE), lines)
    neutral = F.coalesce(_neutral(needs), lines)
    return let(neutral, encode_controls)
