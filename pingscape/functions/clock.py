"""Local time, calendar and period expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import LOCAL_ZONE


def local_time(epoch_seconds: Column, zone: str | Column = LOCAL_ZONE) -> Column:
    """Wall-clock timestamp of epoch seconds in a zone (a name or a column of names)."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch_seconds), zone)


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def previous_sunday(day: Column) -> Column:
    """The Sunday strictly before the day (a Sunday gives the one a week earlier)."""
    return F.date_sub(F.next_day(F.date_sub(day, 1), "SUN"), 7)


def conflict_period(month: Column, default: int | None = None, open_end: bool = False) -> Column:
    """Months 3-4, 5-6, 7-9 as periods 1, 2, 3; other months get `default`.

    With `open_end` every month from 7 on is period 3.
    """
    last = month >= 7 if open_end else month.between(7, 9)
    return (
        F.when(month.between(3, 4), 1)
        .when(month.between(5, 6), 2)
        .when(last, 3)
        .otherwise(F.lit(default).cast("int"))
    )


def midnights_crossed(start: Column, end: Column) -> Column:
    """Number of local midnights between two local times."""
    return F.datediff(F.to_date(end), F.to_date(start))
