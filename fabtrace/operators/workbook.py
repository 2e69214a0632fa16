"""Lot lists and per-lot workbooks merged into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SHEET = "Sheet1"


def lots_from_text(requests: DataFrame, text: str, keep_empty: bool = False) -> DataFrame:
    """One trimmed ``lot`` per entry of a comma-separated list, empty entries dropped."""
    entries = F.transform(F.split(text, ","), lambda x: F.trim(x))
    if not keep_empty:
        entries = F.filter(entries, lambda x: x != "")
    keep = [c for c in requests.columns if c != text]
    return requests.select(*keep, F.explode(entries).alias("lot"))


def sheet_name(name: Column) -> Column:
    """The sheet's name, never empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(DEFAULT_SHEET))
