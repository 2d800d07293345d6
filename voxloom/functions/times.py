"""Times: stamps, elapsed seconds, durations for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(at: Column) -> Column:
    """yyyyMMdd_HHmmss, as file names carry it."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def micros(at: Column) -> Column:
    """Microseconds since 1970, also of times without zone."""
    return F.unix_micros(at.cast("timestamp"))


def seconds_between(begin: Column, end: Column) -> Column:
    return (micros(end) - micros(begin)) / 1e6


def display(seconds: Column) -> Column:
    """h:mm:ss of whole seconds (days run on in the hours); null for null or negative."""
    s = F.floor(seconds).cast("bigint")
    shown = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)
    return F.when(seconds >= 0, shown)


def hours(seconds: Column) -> Column:
    return seconds / 3600
