"""Delay annotations: add, look up, remove and group by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabtrace.functions.display import DASH
from fabtrace.sources.annotations import clean

UNCATEGORIZED = "Uncategorized"
# A category's records are dealt over so many shares, so that no task reads a large one whole.
SHARES = 256


def category() -> Column:
    """The issue, or the name for records without one."""
    return F.coalesce(F.nullif(F.col("ISSUE"), F.lit("")), F.lit(UNCATEGORIZED))


def submitted(rows: DataFrame) -> DataFrame:
    """Rows as entered: the placeholder in ISSUE and REMARKS means none."""
    return clean(
        rows.withColumns({c: F.when(F.col(c) == DASH, "").otherwise(F.col(c)) for c in ("ISSUE", "REMARKS")})
    )


def append(annotations: DataFrame, rows: DataFrame) -> DataFrame:
    return annotations.unionByName(submitted(rows))


def lookup(annotations: DataFrame, keys: DataFrame) -> DataFrame:
    """Annotations of the (lot, operation) pairs in ``keys``, compared as text."""
    return annotations.join(keys, _same_key(keys), "left_semi")


def delete(annotations: DataFrame, keys: DataFrame) -> DataFrame:
    """All annotations but those of the (lot, operation) pairs in ``keys``."""
    return annotations.join(keys, _same_key(keys), "left_anti")


def _same_key(keys: DataFrame) -> Column:
    return F.col("LOT NUMBER").cast("string").eqNullSafe(keys["lot"].cast("string")) & F.col(
        "OPERATION"
    ).cast("string").eqNullSafe(keys["op"].cast("string"))


def categories(annotations: DataFrame) -> DataFrame:
    """Categories in order with their number of records."""
    return (
        annotations.groupBy(category().alias("CATEGORY")).agg(F.count("*").alias("RECORDS")).orderBy("CATEGORY")
    )


def with_size(annotations: DataFrame) -> DataFrame:
    """Every record with its category and that category's size.

    Records meet the size by category and share; records that are equal have the same share.
    """
    share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in annotations.columns]), F.lit(SHARES))
    rows = annotations.withColumn("CATEGORY", category()).withColumn("_share", F.struct("CATEGORY", share.alias("share")))
    shares = rows.groupBy("_share").agg(F.count("*").alias("n")).withColumn("CATEGORY", F.col("_share.CATEGORY"))
    sizes = shares.groupBy("CATEGORY").agg(F.sum("n").alias("RECORDS"))
    # One key: rows hashed by the category alone would do for a join by category and share.
    of_share = shares.join(sizes, "CATEGORY").select("_share", "RECORDS")
    return rows.join(of_share, "_share").select("CATEGORY", *[f"`{c}`" for c in annotations.columns], "RECORDS")


def by_category(annotations: DataFrame) -> DataFrame:
    """Every record with its category and that category's size, in category order."""
    return with_size(annotations).orderBy("CATEGORY", "LOT NUMBER", "OPERATION", "DESCRIPTION")


def of_category(annotations: DataFrame, name: str) -> DataFrame:
    return annotations.where(category() == name)
