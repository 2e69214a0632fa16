"""Table profiles, table fingerprints and run-log triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Log text that decides the class of a run, first match wins.
TRIAGE = [
    (["IllegalOptionException", "customization-profiles"], "invalid option / blocked profile"),
    (
        ["another process has locked a portion of the file", "ConfigurationAreaChecker"],
        "workspace locked",
    ),
    (["EXCEPTION_ACCESS_VIOLATION"], "runtime crash"),
    (["DB Connection no longer available"], "database lost"),
]
EMPTY_TABLE = "created an empty data table"
NO_DATA, FAILED, NO_OUTPUT, OK = "no data for lot", "failed", "no output", "ok"


def columns_of(df: DataFrame) -> DataFrame:
    """Columns of a table with their type, in table order."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def table_profile(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per column: place, name, type, rows, nulls, smallest and largest value.

    Takes one pass over the table.  ``distinct`` adds an approximate count of values.
    """
    profiles = []
    for ordinal, field in enumerate(df.schema.fields, 1):
        c = F.col(f"`{field.name}`")
        profile = [
            F.lit(ordinal).alias("ordinal"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.count("*").alias("row_count"),
            (F.count("*") - F.count(c)).alias("null_count"),
            F.min(c).cast("string").alias("min_value"),
            F.max(c).cast("string").alias("max_value"),
        ]
        if distinct:
            profile.append(F.approx_count_distinct(c).alias("approx_distinct"))
        profiles.append(F.struct(*profile))
    return df.agg(F.array(*profiles).alias("_profiles")).select(F.inline("_profiles"))


def row_fingerprint(df: DataFrame) -> Column:
    """First ten hex digits of the hash of a row's text."""
    return F.substring(F.md5(_row_text(df)), 1, 10)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with the table's content but not with its row order.

    The xor catches any single change, the sum also rows added or removed in pairs.
    """
    h = F.conv(F.substring(F.md5(_row_text(df)), 1, 15), 16, 10).cast("bigint")
    return df.select(h.alias("_h")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum_hash"),
    )


def _row_text(df: DataFrame) -> Column:
    # Each value after its length, so that different rows have different texts; a dash is null.
    texts = [F.col(f"`{c}`").cast("string") for c in df.columns]
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.concat(*parts)


def triage(log_text: Column, exit_code: Column, has_output: Column) -> Column:
    """Class of a run from its log."""
    rule = F
    for texts, name in TRIAGE:
        hit = F.lit(False)
        for text in texts:
            hit = hit | log_text.contains(text)
        rule = rule.when(hit, name)
    return (
        rule.when(log_text.contains(EMPTY_TABLE) & ~has_output, NO_DATA)
        .when(exit_code != 0, FAILED)
        .when(~has_output, NO_OUTPUT)
        .otherwise(OK)
    )


def triage_counts(runs: DataFrame) -> DataFrame:
    """Number of runs per class; an unreadable log counts as empty."""
    log = F.coalesce(F.col("log_text"), F.lit(""))
    return runs.groupBy(triage(log, F.col("exit_code"), F.col("has_output")).alias("run_class")).agg(
        F.count("*").alias("runs")
    )
