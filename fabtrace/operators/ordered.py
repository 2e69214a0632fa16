"""Time-ordered windows over a lot's rows.

There is one path for every lot: its rows are sorted by one task, which spills what memory
does not hold and reads the sorted rows once. Rows without a time come last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prev:
    """Value of ``col`` on the previous row; ``default`` only where there is no such row."""

    col: str
    default: Any = None


@dataclass(frozen=True)
class Next:
    """Value of ``col`` on the next row; ``default`` only where there is no such row."""

    col: str
    default: Any = None


@dataclass(frozen=True)
class Running:
    """``max``, ``sum``, ``count`` or ``last`` non-null of ``col`` up to the current row."""

    fn: str
    col: str


@dataclass(frozen=True)
class Earlier:
    """Last non-null value of ``col`` before the current row."""

    col: str


Output = Prev | Next | Running | Earlier


@dataclass(frozen=True)
class By:
    """Window columns to add over ``keys``."""

    keys: Sequence[str]
    outputs: Mapping[str, Output]


def with_ordered(df: DataFrame, order: Sequence[str], *specs: By) -> DataFrame:
    """Add ordered window columns; nulls sort last.

    Specs come widest keys first, so one shuffle serves them all.
    """
    sort = [F.col(c).asc_nulls_last() for c in order]
    for spec in specs:
        w = Window.partitionBy(*spec.keys).orderBy(*sort)
        df = df.withColumns({name: _over(o, w) for name, o in spec.outputs.items()})
    return df


def with_group_value(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add an aggregate over all rows of each group."""
    return df.withColumn(name, value.over(Window.partitionBy(*keys)))


def _over(o: Output, w) -> Column:
    if isinstance(o, Prev):
        return F.lag(o.col, 1, o.default).over(w)
    if isinstance(o, Next):
        return F.lead(o.col, 1, o.default).over(w)
    last = F.last(o.col, ignorenulls=True)
    if isinstance(o, Earlier):
        return last.over(w.rowsBetween(Window.unboundedPreceding, -1))
    value = last if o.fn == "last" else {"max": F.max, "sum": F.sum, "count": F.count}[o.fn](o.col)
    return value.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
