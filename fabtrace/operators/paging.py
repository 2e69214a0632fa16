"""Pages over an ordered table of any size.

Rows are ordered by any columns; nulls come last, and rows equal in all of these follow each
other by their other columns. Three ways lead to a page:

* ``ranked`` sorts the table once: a range exchange on sampled bounds, a sort of every range and a
  count of each. A row's number is its place in its range plus the rows of earlier ranges. The
  sorted rows are kept, so any page is read from the files that hold it.
* ``page_of`` without a ranking is a top-k for pages near the start and ranks for later ones.
* ``page_after`` goes on from the last row seen, at the same cost on every page.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from fabtrace.sources.scratch import cut

PAGE_SIZE = 200
# Rows up to a page's end that a top-k of an unranked table may hold.
TOP_ROWS = 10_000
# Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_PLACE_BITS = 33


def _sorted_by(df: DataFrame, order: Sequence[str], descending: Collection[str]) -> list[Column]:
    """The order's columns, then all others that can be compared."""
    others = [
        f.name for f in df.schema if f.name not in order and not isinstance(f.dataType, (MapType, VariantType))
    ]
    return [
        F.col(f"`{c}`").desc_nulls_last() if c in descending else F.col(f"`{c}`").asc_nulls_last()
        for c in [*order, *others]
    ]


@dataclass(frozen=True)
class Ranked:
    """A table sorted by ranges: its rows with ``_place``, and (range, rows) of every range."""

    rows: DataFrame
    ranges: list[tuple[int, int]]
    columns: list[str]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.ranges)

    def _before(self) -> dict[int, int]:
        return dict(zip((r for r, _ in self.ranges), accumulate((n for _, n in self.ranges), initial=0)))  # noqa: B905

    def _number(self, offsets: Column) -> Column:
        return F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + offsets + 1

    def with_row_number(self, name: str = "row_number") -> DataFrame:
        """All rows numbered from 1. The offsets sent along are one number per range."""
        spark = self.rows.sparkSession
        before = F.broadcast(
            spark.createDataFrame(list(self._before().items()), "_range int, _before long")
        )
        placed = self.rows.withColumn("_range", F.shiftright("_place", _PLACE_BITS).cast("int"))
        numbered = placed.join(before, "_range")
        return numbered.select(*[f"`{c}`" for c in self.columns], self._number(F.col("_before")).alias(name))

    def slice(self, start: int, size: int, name: str = "row_number") -> DataFrame:
        """Rows ``start`` + 1 to ``start`` + ``size`` in order; only their files are read."""
        wanted, number = F.lit(False), F
        before = self._before()
        for r, n in self.ranges:
            low, high = max(0, start - before[r]), min(n, start + size - before[r])
            if low < high:
                base = r << _PLACE_BITS
                own = F.col("_place").between(base + low, base + high - 1)
                wanted = wanted | own
                number = number.when(own, self._number(F.lit(before[r])))
        found = self.rows.where(wanted)
        numbered = found.withColumn(name, F.lit(None).cast("long") if number is F else number)
        return numbered.orderBy("_place").select(*[f"`{c}`" for c in self.columns], name)


def ranked(df: DataFrame, order: Sequence[str], descending: Collection[str] = ()) -> Ranked:
    """Sort a table and keep it in the shared folder.

    The range exchange samples the order for its bounds. Rows that agree in all columns can't
    be told apart and stay in one range. Only a count per range comes to the driver.
    """
    sort = _sorted_by(df, order, descending)
    # A range and the place in it are what this function counts by.
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = cut(placed.withColumn("_place", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_place", _PLACE_BITS).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return Ranked(rows, sorted((x.r, x.n) for x in sizes.collect()), df.columns)


def with_row_number(
    df: DataFrame, order: Sequence[str], name: str = "row_number", descending: Collection[str] = ()
) -> DataFrame:
    """Number all rows from 1 in the given order."""
    return ranked(df, order, descending).with_row_number(name)


def with_page(
    df: DataFrame, order: Sequence[str], page_size: int = PAGE_SIZE, descending: Collection[str] = ()
) -> DataFrame:
    """Add the row number and the page each row is on."""
    numbered = with_row_number(df, order, descending=descending)
    return numbered.withColumn("page", (F.floor((F.col("row_number") - 1) / page_size) + 1).cast("int"))


def page_info(df: DataFrame, number: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row: total rows, pages, the page shown and its first and last row.

    A page out of range is ignored, which leaves the first page.
    """
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("int")
    page = F.when(F.lit(number).between(1, F.col("pages")), number).otherwise(1)
    start = (F.col("page") - 1) * page_size
    return (
        df.agg(F.count("*").alias("total"))
        .withColumn("pages", pages)
        .withColumn("page", page)
        .withColumn("showing_from", F.when(F.col("total") == 0, 0).otherwise(start + 1))
        .withColumn("showing_to", F.least(start + page_size, F.col("total")))
    )


def page_of(
    df: DataFrame | Ranked,
    order: Sequence[str],
    number: int,
    page_size: int = PAGE_SIZE,
    descending: Collection[str] = (),
) -> DataFrame:
    """Rows of one page in order, with their row number and page; the first if out of range.

    Pages within the first TOP_ROWS rows of a table are a top-k. For a later one the table is
    ranked; with a ranking at hand (``df`` is what ``ranked`` gave) every page is read from its
    own files.
    """
    start = max(0, number - 1) * page_size
    if isinstance(df, Ranked) or start + page_size > max(TOP_ROWS, page_size):
        table = df if isinstance(df, Ranked) else ranked(df, order, descending)
        if start >= table.total:
            start = 0
        return table.slice(start, page_size).withColumn("page", F.lit(start // page_size + 1))
    if start and df.select(F.lit(1)).limit(start + 1).count() <= start:
        start = 0
    sort = _sorted_by(df, order, descending)
    rows = df.orderBy(*sort).offset(start).limit(page_size)
    place = F.row_number().over(Window.orderBy(*sort)) + F.lit(start)
    return rows.withColumns({"row_number": place.cast("long"), "page": F.lit(start // page_size + 1)})


def page_after(
    df: DataFrame,
    order: Sequence[str],
    last: Mapping[str, Any] | None,
    page_size: int = PAGE_SIZE,
    descending: Collection[str] = (),
) -> DataFrame:
    """The next rows in order after a row with the values ``last`` of the order's columns.

    None gives the first rows. The order has to tell rows apart, as by a key at its end: rows
    equal to ``last`` count as seen. The comparison reaches the scan, and a top-k of a page's
    size is all that is gathered.
    """
    rows = df
    if last is not None:
        # Of the columns' own types, so that no column is cast and the scan can compare.
        seen = {c: None if last[c] is None else F.lit(last[c]).cast(df.schema[c].dataType) for c in order}
        beyond, first = F.lit(False), True
        for c in reversed(order):
            column, value = F.col(f"`{c}`"), seen[c]
            if value is None:  # nulls come last, so only nulls may follow
                further, same = F.lit(False), column.isNull()
            else:
                further = column.isNull() | (column < value if c in descending else column > value)
                same = column == value
            beyond = further if first else further | (same & beyond)
            first = False
        rows = df.where(beyond)
        lead, value = F.col(f"`{order[0]}`"), seen[order[0]]
        if value is not None:  # said apart from the rest, for the scan
            rows = rows.where(lead.isNull() | (lead <= value if order[0] in descending else lead >= value))
    return rows.orderBy(*_sorted_by(df, order, descending)).limit(page_size)
