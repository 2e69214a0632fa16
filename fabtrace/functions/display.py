"""Display values of order and delay cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholder, and the class key of each known status and priority.
DASH = "—"
STATUS_CLASS = {
    "In Production": "in-production",
    "Confirmed": "confirmed",
    "Warning": "warning",
    "Done": "done",
    "Terminated": "terminated",
}
PRIORITY_CLASS = {"Hot": "hot", "Rocket": "rocket", "Normal": "normal"}
OTHER_CLASS = "x"


def dash_if_empty(c: Column, python_falsy: bool = False) -> Column:
    """Text of a cell, with a dash for null and empty (and zero when ``python_falsy``)."""
    text = c.cast("string")
    empty = text.isNull() | (text == "")
    if python_falsy:
        empty = empty | F.coalesce(c.try_cast("double") == 0, F.lit(False))
    return F.when(empty, DASH).otherwise(text)


def _fixed(v: Column, pattern: str) -> Column:
    # Rounds the exact binary value half to even, as the source's formatting does.
    return F.call_function("format_number", v, F.lit(pattern))


def _as_number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def short_delta(c: Column) -> Column:
    """Whole numbers without decimals, others with one; text stays; null is a dash."""
    v = _as_number(c)
    return (
        F.when(c.isNull() | F.isnan(v), DASH)
        .when(v == F.floor(v), F.floor(v).cast("string"))
        .when(v.isNotNull(), _fixed(v, "0.0"))
        .otherwise(c.cast("string"))
    )


def delta_text(c: Column) -> Column:
    """Four decimals; text stays; null is a dash."""
    v = _as_number(c)
    return (
        F.when(c.isNull() | F.isnan(v), DASH)
        .when(v == 0, "0.0000")
        .when(v.isNotNull(), _fixed(v, "0.0000"))
        .otherwise(c.cast("string"))
    )


def delta_sign(c: Column) -> Column:
    """``negative``, ``positive`` or ``zero``; ``text`` if not a number, empty when null."""
    v = _as_number(c)
    return (
        F.when(c.isNull() | F.isnan(v), "")
        .when(v < 0, "negative")
        .when(v > 0, "positive")
        .when(v == 0, "zero")
        .otherwise("text")
    )


def _class_of(c: Column, classes: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in classes.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(OTHER_CLASS))


def status_class(c: Column) -> Column:
    return _class_of(c, STATUS_CLASS)


def priority_class(c: Column) -> Column:
    return _class_of(c, PRIORITY_CLASS)
