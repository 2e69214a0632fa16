"""Date arithmetic in fractional days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Whole microseconds from ``start`` to ``end``; exact, so sums of it are exact too."""
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days from ``start`` to ``end`` as a double."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def parse_timestamp(text: Column | str) -> Column:
    """Timestamp without time zone from text; null when it does not parse."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")
