"""Date scalars; what depends on the present takes it as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO date and time to a naive UTC timestamp; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz")


def strip_timezone(text: Column) -> Column:
    """A time with an offset as a naive UTC time; one without stays as it is, what is none is null."""
    return parse_iso(text)


def whole_days(then: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 86400)


def time_decay(then: Column, now: Column, rate: float = 0.01) -> Column:
    """exp(-rate * whole days), 1 for the future."""
    return F.exp(F.lit(-rate) * F.greatest(F.lit(0), whole_days(then, now)))


def time_ago(then: Column, now: Column) -> Column:
    """The age of a time in its largest whole unit."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    says = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, says(seconds / 60, "minutes"))
        .when(seconds < 86400, says(seconds / 3600, "hours"))
        .when(seconds < 86400 * 30, says(seconds / 86400, "days"))
        .when(seconds < 86400 * 365, says(seconds / (86400 * 30), "months"))
        .otherwise(says(seconds / (86400 * 365), "years"))
    )


def beijing(utc: Column) -> Column:
    """Shanghai wall time of a naive UTC time."""
    return F.from_utc_timestamp(utc.cast("timestamp"), "Asia/Shanghai").cast("timestamp_ntz")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Does an interval meet [low, high]; an open end counts as its start. Null bounds are open."""
    closed = end.isNotNull() & F.coalesce(start <= high, F.lit(True)) & F.coalesce(end >= low, F.lit(True))
    opened = end.isNull() & F.coalesce(start >= low, F.lit(True)) & F.coalesce(start <= high, F.lit(True))
    return start.isNotNull() & (closed | opened)
