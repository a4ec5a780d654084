"""Reading JSON as variants: strict documents and tolerant leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise.functions.text import strip

# Closes the wrapping array, so text holding more or less than one document is told apart.
_END = "\u0001end"


def wrapped(text: Column) -> Column:
    """Parse text inside a two-element array whose second element is a known mark."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"\\u0001end"]')))


def is_document(parsed: Column) -> Column:
    """Whether the wrapped text was exactly one JSON document."""
    mark = F.try_variant_get(parsed, "$[1]", "string")
    extra = F.try_variant_get(parsed, "$[2]", "variant")
    return F.coalesce((mark == F.lit(_END)) & extra.isNull(), F.lit(False))


def document(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$[0]", "variant")


def leaf(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def taken(value: Column, schema: str) -> Column:
    """An object read once as a struct; a field missing or of a kind its type cannot be read from is null.

    A field of type `binary` is filled by a JSON string only: no other kind can be read as bytes.
    """
    return F.try_variant_get(value, "$", schema)


def is_object(value: Column) -> Column:
    return taken(value, "struct<_: variant>").isNotNull()


def is_null(value: Column) -> Column:
    """Missing, or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def string(value: Column) -> Column:
    """A JSON string; null for any other kind."""
    return F.try_variant_get(value, "$", "binary").cast("string")


def number(value: Column) -> Column:
    """A JSON number as a double; null for any other kind. Only a number's own text reads as one."""
    return F.to_json(value).try_cast("double")


def text(read: Column) -> Column:
    """A trimmed string from a field taken as `binary`; anything but a string reads as empty."""
    return F.coalesce(strip(read.cast("string")), F.lit(""))


def count(digits: Column) -> Column:
    """A count from a leaf's own JSON text: a number cut to an integer; negative or any other kind reads as null."""
    whole = F.coalesce(digits.try_cast("bigint"), digits.try_cast("double").try_cast("decimal(38,6)").try_cast("bigint"))
    return F.when(whole >= 0, whole)
