"""Timestamps as they turn up in logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise.functions.json import number, string
from meterwise.functions.text import strip

# Epoch numbers above this are milliseconds; the range is years 1 to 9999.
MILLISECONDS_ABOVE = 1e11
EPOCH_RANGE = (-62135596800, 253402300799)

_DATE = r"([0-9]{4})-?([0-9]{2})-?([0-9]{2})"
_CLOCK = r"([0-9]{2})(?::?([0-9]{2}))?(?::?([0-9]{2}))?(?:[.,]([0-9]+))?"
_ZONE = r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?"
_ISO = rf"^{_DATE}(?:.{_CLOCK}{_ZONE})?$"
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 text, dates alone included; no zone means UTC, anything else is null."""

    def part(i: int, default: str) -> Column:
        found = F.regexp_extract(text, _ISO, i)
        return F.when(found == "", default).otherwise(found)

    zone = part(8, "Z")
    zone = F.when(zone.rlike(r"^[+-][0-9]{2}$"), F.concat(zone, F.lit(":00"))).otherwise(
        F.regexp_replace(zone, r"^([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    )
    rebuilt = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit("T"),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit("."),
        part(7, "0"), zone,
    )
    return F.when(text.rlike(_PLAIN), F.try_to_timestamp(text)).when(
        text.rlike(_ISO), F.try_to_timestamp(rebuilt)
    )


def epoch_timestamp(value: Column) -> Column:
    """Epoch seconds, or milliseconds when the number is too large to be seconds."""
    sec = F.when(value > MILLISECONDS_ABOVE, value / 1000).otherwise(value)
    return F.when(
        sec.between(*EPOCH_RANGE), F.timestamp_micros(F.rint(sec * 1000000).cast("bigint"))
    )


def timestamp(value: Column) -> Column:
    """A timestamp from a JSON string or number; any other kind is null."""
    return F.coalesce(iso_timestamp(strip(string(value))), epoch_timestamp(number(value)))
