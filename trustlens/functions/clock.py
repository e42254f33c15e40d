"""One explicit clock for every operator.

The metrics depend on "now" (time weights, 30/60-day periods). Operators take an
``as_of`` value instead of calling the current time, so results are repeatable and
every query in a job sees the same instant. ``None`` means the session's current local
time, fixed once per query by Spark.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

AsOf = datetime | date | str | Column | None


def as_of_ts(as_of: AsOf = None) -> Column:
    """``as_of`` as a ``timestamp_ntz`` column (a literal, so Catalyst folds it)."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            raise ValueError("as_of must be zone-free, like the data's timestamps; convert it to their zone first")
        text = as_of.isoformat(sep=" ")
    else:
        text = str(as_of)
    # A string cast is zone-free, unlike a Python datetime literal.
    return F.lit(text).cast("timestamp_ntz")


def fixed_as_of(spark: SparkSession, as_of: AsOf = None) -> AsOf:
    """``as_of`` itself, or the session's current local time as a fixed text: one instant for
    a call that runs several queries."""
    if as_of is not None:
        return as_of
    return spark.range(1).select(F.localtimestamp().cast("string")).first()[0]


def as_of_date(as_of: AsOf = None) -> Column:
    """The calendar day of ``as_of`` (the reference's CURRENT_DATE)."""
    return F.to_date(as_of_ts(as_of))


def day_start(as_of: AsOf, days_back: int) -> Column:
    """Midnight ``days_back`` days before the day of ``as_of`` (CURRENT_DATE - INTERVAL n DAY)."""
    return F.date_sub(as_of_date(as_of), days_back).cast("timestamp_ntz")


def days_before(as_of: AsOf, days: int) -> Column:
    """``as_of`` minus exactly ``days`` x 24 hours, to the microsecond."""
    return as_of_ts(as_of) - F.make_dt_interval(F.lit(days))
