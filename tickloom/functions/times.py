"""Times to nanoseconds since the epoch; Spark's timestamps hold microseconds, so the fraction goes by text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _fail(what: str, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(text, F.lit("null"))))


def non_negative(value: Column) -> Column:
    return F.when(value >= 0, value).otherwise(F.raise_error(F.concat(F.lit("negative time: "), F.coalesce(value.cast("string"), F.lit("null")))))


def rfc3339_to_ns(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, _RFC3339, k)
    zone = F.when(F.upper(part(4)) == "Z", F.lit("+00:00")).otherwise(part(4))
    seconds = F.unix_seconds(F.concat(part(1), F.lit("T"), part(2), zone).cast("timestamp"))
    fraction = F.rpad(F.substring(F.concat(part(3), F.lit(".")), 2, 9), 9, "0")
    nanos = F.translate(fraction, ".", "0").cast("long")
    return F.when(text.rlike(_RFC3339), non_negative(seconds * F.lit(1_000_000_000).cast("long") + nanos)).otherwise(_fail("not an RFC 3339 time", text))


def millis_to_ns(text: Column) -> Column:
    """Unsigned milliseconds as text; overflow raises."""
    return F.when(text.rlike(r"^\+?\d+$"), text.cast("long") * F.lit(1_000_000).cast("long")).otherwise(_fail("not a time in milliseconds", text))


def mixed_to_ns(text: Column) -> Column:
    """RFC 3339 if there is a T, else milliseconds."""
    return F.when(F.contains(text, F.lit("T")), rfc3339_to_ns(text)).otherwise(millis_to_ns(text))
