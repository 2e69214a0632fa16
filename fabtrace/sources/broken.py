"""Telling JSON records that can be read from those that can't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROKEN = "_broken"


def readable(rows: DataFrame) -> DataFrame:
    """The records that could be read, without the column for broken text."""
    return rows.where(F.col(BROKEN).isNull() & _another(rows)).drop(BROKEN)


def broken(rows: DataFrame) -> DataFrame:
    """The records that couldn't be read; their text is in BROKEN."""
    return rows.where(F.col(BROKEN).isNotNull() & _another(rows))


def _another(rows: DataFrame):
    # Always true. The reader gives the broken text only if another column is asked for, too.
    other = next(c for c in rows.columns if c != BROKEN)
    return F.length(F.coalesce(F.col(f"`{other}`"), F.lit(""))) >= 0
