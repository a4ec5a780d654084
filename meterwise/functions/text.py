"""String columns: trimming, model and price-list keys, number and quantity rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise.settings import GEO_PREFIXES, SERVICE_NAME_SUFFIX

# The characters that count as white space around a field.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def model_scope(model_id: Column) -> Column:
    """`global` for a global inference profile, else `regional`."""
    return F.when(strip(F.lower(model_id)).startswith("global."), "global").otherwise("regional")


def model_key(model_id: Column) -> Column:
    """A model id as the space-separated words that decide its price.

    String functions only, so the expression stays inside generated code and can run on every row
    of a log scan; no second pass over the log is needed to collect the distinct ids.
    """
    bare = F.regexp_replace(strip(F.lower(model_id)), rf"^(?:{'|'.join(GEO_PREFIXES)})\.", "")
    bare = F.substring_index(F.substring_index(bare, "/", -1), ":", 1)
    words = F.trim(F.regexp_replace(bare, r"[.\-_]+", " "))
    # Release dates and the base version carry no price; the first word is always kept.
    words = F.regexp_replace(words, r" (?:[0-9]{8}|v1)(?= |$)", "")
    return F.regexp_replace(words, r"^anthropic(?: |$)", "")


def service_key(name: Column) -> Column:
    """A price-list service name in the same form as `model_key`."""
    bare = strip(F.lower(name))
    bare = F.when(
        bare.endswith(SERVICE_NAME_SUFFIX),
        F.substring(bare, F.lit(1), F.length(bare) - len(SERVICE_NAME_SUFFIX)),
    ).otherwise(bare)
    words = F.regexp_replace(F.replace(bare, F.lit("+"), F.lit(" plus ")), r"[\s.\-_/()]+", " ")
    words = F.regexp_replace(F.trim(words), r"(?<![^ ])model(?: |$)", "")
    return F.trim(words)


def quoted(value: Column) -> Column:
    """A rule literal: backslash and double quote are escaped, nothing else."""
    slashed = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.replace(slashed, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _bound(value: Column, rounding) -> Column:
    # The shortest decimal text of the double is settled at nine places before it is rounded.
    exact = value.cast("string").try_cast("decimal(38,18)")
    settled = F.bround(exact, 9).cast("decimal(38,9)")
    text = rounding(settled).cast("string")
    trimmed = F.when(
        F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")
    ).otherwise(text)
    return F.coalesce(trimmed, F.format_string("%.0f", value))


def plain_number(value: Column) -> Column:
    """Plain decimal text at six places, half to even, never an exponent."""
    return _bound(value, lambda x: F.bround(x, 6))


def lower_bound(value: Column) -> Column:
    """Plain decimal text rounded down at six places, so no observed value falls outside."""
    return _bound(value, lambda x: F.floor(x, F.lit(6)))


def upper_bound(value: Column) -> Column:
    """Plain decimal text rounded up at six places."""
    return _bound(value, lambda x: F.ceil(x, F.lit(6)))


def thousands(value: Column) -> Column:
    """1234567 as `1,234,567`."""
    return F.format_number(value, 0)


def short_number(value: Column) -> Column:
    """Integers in full; other numbers with six significant digits and no zeros at the end."""
    value = value.cast("double")
    digits = F.regexp_replace(
        F.format_string("%.6g", value), r"(?:\.0+|(\.[0-9]*[1-9])0+)(?=e|$)", "$1"
    )
    whole = F.when(value == F.rint(value), value.cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, digits)


def percent(fraction: Column) -> Column:
    """0.873 as `87%`."""
    return F.concat(F.bround(fraction * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value.cast("double"))


def stamp(ts: Column) -> Column:
    """A timestamp as ISO text in UTC with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def megabytes(value: Column) -> Column:
    gb = (value >= 1024) & (value % 1024 == 0)
    text = F.concat(short_number(value), F.lit(" MB"))
    return F.when(
        gb, F.concat(text, F.lit(" ("), short_number(value / 1024), F.lit(" GB)"))
    ).otherwise(text)


def seconds(value: Column) -> Column:
    text = F.concat(short_number(value), F.lit(" s"))
    hours = value / 3600
    return (
        F.when(
            (value >= 3600) & (value % 3600 == 0),
            F.concat(
                text, F.lit(" ("), short_number(hours),
                F.when(hours == 1, " hour)").otherwise(" hours)"),
            ),
        )
        .when(
            (value >= 120) & (value % 60 == 0),
            F.concat(text, F.lit(" ("), short_number(value / 60), F.lit(" minutes)")),
        )
        .otherwise(text)
    )


def milliseconds(value: Column) -> Column:
    return F.concat(short_number(value), F.lit(" ms"))
