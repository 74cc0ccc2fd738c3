"""Image dimensions.  PNG is read with expressions; JPEG needs a segment walk."""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import unpack_from

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JPEG markers without a length, and the start-of-frame markers.
BARE_MARKERS = frozenset([0x01, 0xD8, 0xD9, *range(0xD0, 0xD8)])
FRAME_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
# Bytes before a marker's code: at least one 0xFF in a well-formed file, none are missed in others.
MARKER = re.compile(rb"\xff*([^\xff])", re.S)


def jpeg_segments(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """Marker and payload of each whole segment after the start-of-image marker."""
    view, at = memoryview(data), 2
    while (found := MARKER.match(view, at)) is not None:
        code, at = found.group(1)[0], found.end()
        if code in BARE_MARKERS:
            continue
        if at + 2 > len(view) or (size := unpack_from(">H", view, at)[0]) < 2 or at + size > len(view):
            return
        yield code, view[at + 2:at + size]
        at += size


def jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first frame header, or nothing."""
    if not data or not data.startswith(b"\xff\xd8"):
        return None
    frame = next((payload for code, payload in jpeg_segments(data) if code in FRAME_MARKERS), None)
    if frame is None or len(frame) < 5:
        return None
    height, width = unpack_from(">HH", frame, 1)
    return width, height


@F.pandas_udf(T.StructType().add("width", T.LongType()).add("height", T.LongType()))
def jpeg_dimensions(content: pd.Series) -> pd.DataFrame:
    sizes = [jpeg_size(None if c is None else bytes(c)) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int64")


def big_endian(content: Column, offset: int, length: int) -> Column:
    digits = F.hex(F.substring(content, offset + 1, length))
    return F.conv(digits, 16, 10).cast("bigint")


def png_dimensions(content: Column) -> Column:
    head = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (
        F.hex(F.substring(content, 13, 4)) == "49484452"
    )
    return F.when(
        head & (F.octet_length(content) >= 24),
        F.struct(
            big_endian(content, 16, 4).alias("width"), big_endian(content, 20, 4).alias("height")
        ),
    )
