"""Typed reads from parsed JSON.

A plain variant cast would turn ``5`` into ``'5'`` and ``"12"`` into ``12.0``; the
archive treats a value of another type as absent, so every read checks the type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import byte_truncate, let


NUMERIC = "^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def strict_json(c: Column) -> Column:
    """Parsed value of a text that is exactly one JSON value, else null.

    The plain parser ignores what follows the first value; inside an array with an end
    mark nothing can follow unnoticed.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit(",null]")))

    def only(a: Column) -> Column:
        alone = F.is_variant_null(sub(a, "$[1]")) & sub(a, "$[2]").isNull()
        return F.when(alone, sub(a, "$[0]"))

    return let(wrapped, only)


def sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def string_at(v: Column, path: str) -> Column:
    return let(sub(v, path), lambda x: F.when(kind(x) == "STRING", x.cast("string")))


def object_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def array_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def shaped(v: Column, shape: str) -> Column:
    """The named fields of an object in one pass; null when ``v`` is not an object.

    A field that is absent, or whose value does not fit its type, is null by itself.
    """
    return F.try_variant_get(v, "$", shape)


def text_of(v: Column) -> Column:
    """The text of a string value."""
    return F.when(kind(v) == "STRING", v.cast("string"))


def first_text(values: list[Column], max_bytes: int | None = None) -> Column:
    """The first value that is a string; a shown one may be cut to a number of bytes."""
    found = F.coalesce(*[text_of(v) for v in values])
    return found if max_bytes is None else byte_truncate(found, max_bytes)


def first_flag(values: list[Column]) -> Column:
    return F.coalesce(*[F.when(kind(v) == "BOOLEAN", v.cast("boolean")) for v in values])


def number_of(v: Column) -> Column:
    """A finite JSON number as a double."""
    value = F.when(kind(v).rlike(NUMERIC), v.cast("double"))
    return let(value, lambda x: F.when(F.abs(x) < float("inf"), x))
