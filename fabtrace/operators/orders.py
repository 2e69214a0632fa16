"""The order board: known columns, filters, facets, status counts and cell texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabtrace.functions import display
from fabtrace.sources.schemas import ORDER_COLUMNS

# The owner shown by default, and the status tiles.
DEFAULT_OWNER = "DEVT"
STATUS_TILES = ["In Production", "Confirmed", "Done", "Warning"]


def named(column: str) -> Column:
    """A column whose name may hold dots and spaces."""
    return F.col(f"`{column}`")


def board(orders: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Known order attributes under their board names, as many as the table has."""
    known = [F.col(k).alias(v) for k, v in ORDER_COLUMNS.items() if k in orders.columns]
    return orders.select(*keep, *known)


def owners(orders: DataFrame) -> DataFrame:
    """Distinct owners, sorted."""
    return orders.select("Owner").where(F.col("Owner").isNotNull()).distinct().orderBy("Owner")


def of_owners(orders: DataFrame, selected: Sequence[str] | None = None) -> DataFrame:
    """Orders of the selected owners; an empty selection keeps all.

    Without a selection the default owner is used if any order has it, else every known one.
    """
    owner = F.col("Owner")
    if selected is None:
        has_default = orders.agg(F.max(owner == DEFAULT_OWNER)).scalar()
        return orders.where(owner.isNotNull() & ((owner == DEFAULT_OWNER) | ~has_default))
    if not selected:
        return orders
    return orders.where(owner.isin(list(selected)))


def search_lots(orders: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Orders whose lot number contains the text, a regular expression unless ``literal``.

    Case is ignored by upper-casing both sides, the expression included; blank keeps all and
    an unknown lot number never matches.
    """
    needle = text.strip().upper()
    if not needle:
        return orders
    lot = F.upper("Lot Number")
    return orders.where(lot.contains(needle) if literal else lot.rlike(needle))


def of_facets(orders: DataFrame, selected: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Orders passing every column's selection of values.

    None is no filter, and so is a selection of every value the column has; an empty selection
    of a column that has values keeps nothing. One pass finds the columns with a value that
    isn't selected.
    """
    chosen = {
        c: F.coalesce(named(c).cast("string").isin(list(v)), F.lit(False)) for c, v in selected.items() if v is not None
    }
    if not chosen:
        return orders
    outside = [F.max(named(c).isNotNull() & ~test) for c, test in chosen.items()]
    limited = orders.agg(F.array(*[F.coalesce(x, F.lit(False)) for x in outside]).alias("limited")).scalar()
    kept = F.lit(True)
    for i, test in enumerate(chosen.values()):
        kept = kept & (test | ~limited[i])
    return orders.where(kept)


def facets(orders: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct known values of each column as text, sorted: one (facet, value) row each."""
    shown = columns or [c for c in ORDER_COLUMNS.values() if c in orders.columns]
    cells = F.array(
        *[F.struct(F.lit(c).alias("facet"), named(c).cast("string").alias("value")) for c in shown]
    )
    return (
        orders.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("facet", "value")
    )


def search_options(options: DataFrame, text: str) -> DataFrame:
    """Facet options containing the text, ignoring case."""
    return options.where(F.lower("value").contains(text.lower()))


def status_counts(orders: DataFrame) -> DataFrame:
    status = named("Order Status")
    return orders.where(status.isNotNull()).groupBy(status).agg(F.count("*").alias("orders"))


def status_tiles(orders: DataFrame) -> DataFrame:
    """One row: all orders and the orders in each status that has a tile."""
    return orders.agg(
        F.count("*").alias("Total Orders"),
        *[F.count_if(named("Order Status") == s).alias(s) for s in STATUS_TILES],
    )


def cells(orders: DataFrame, keep: Sequence[str] = (), python_falsy: bool = False) -> DataFrame:
    """Texts shown in the board, with the class of status, priority and delay."""
    delta = "Delta Current To Plan"
    texts = [
        (display.delta_text(named(c)) if c == delta else display.dash_if_empty(named(c), python_falsy)).alias(c)
        for c in ORDER_COLUMNS.values()
        if c in orders.columns
    ]
    classes = {
        "status_class": (display.status_class, "Order Status"),
        "priority_class": (display.priority_class, "Priority"),
        "delta_sign": (display.delta_sign, delta),
        "highlight": (lambda c: F.coalesce(c == "Confirmed", F.lit(False)), "Order Status"),
    }
    return orders.select(
        *keep, *texts, *[f(named(c)).alias(n) for n, (f, c) in classes.items() if c in orders.columns]
    )
