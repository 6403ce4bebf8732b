"""Human-readable labels for times, lengths and sizes. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whisperlake.functions.text import as_col, plain_decimal


def day_of(seconds: str | Column) -> Column:
    """Calendar date of a unix time in the session time zone."""
    return F.to_date(F.timestamp_seconds(as_col(seconds)))


def _relative(seconds: Column, now: Column, today: Column, older: str) -> Column:
    stamp = F.timestamp_seconds(seconds)
    age = F.datediff(day_of(now), day_of(seconds))
    return (
        F.when(age == 0, today)
        .when(age == 1, F.lit("Yesterday"))
        .when(age < 7, F.date_format(stamp, "EEEE"))
        .otherwise(F.date_format(stamp, older))
    )


def day_label(seconds: str | Column, now: str | Column, long_date: str = "EEEE, dd MMMM yyyy") -> Column:
    """Date separator: Today, Yesterday, weekday within the week (later days too), else a full date."""
    return _relative(as_col(seconds), as_col(now), F.lit("Today"), long_date)


def time_label(
    seconds: str | Column, now: str | Column, clock: str = "HH:mm", short_date: str = "MM/dd/yyyy"
) -> Column:
    """List label: clock time today, then as ``day_label`` but with a short date."""
    seconds = as_col(seconds)
    return _relative(seconds, as_col(now), F.date_format(F.timestamp_seconds(seconds), clock), short_date)


def duration_label(seconds: str | Column) -> Column:
    """``m:ss``, or ``h:mm:ss`` from one hour on (hours within the day)."""
    total = F.floor(F.greatest(as_col(seconds).cast("double"), F.lit(0.0))).cast("bigint")
    part = lambda unit, size: F.pmod(F.floor(total / unit).cast("bigint"), F.lit(size))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(
        total >= 3600, F.concat_ws(":", part(3600, 24).cast("string"), two(part(60, 60)), two(part(1, 60)))
    ).otherwise(F.concat_ws(":", part(60, 60).cast("string"), two(part(1, 60))))


def size_label(n_bytes: str | Column) -> Column:
    """Whole KB (at least 1) below one MiB, else MB with at most one decimal."""
    n = as_col(n_bytes).cast("bigint")
    kb = F.greatest(F.lit(1), F.floor(n / 1024)).cast("string")
    mb = plain_decimal(n.cast("decimal(20,0)") / F.lit(1024 * 1024).cast("decimal(10,0)"), 1)
    return F.when(n < 1024 * 1024, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def media_label(n_bytes: str | Column, seconds: str | Column) -> Column:
    """Length where known, else size."""
    return F.when(as_col(seconds).isNotNull(), duration_label(seconds)).otherwise(size_label(n_bytes))
