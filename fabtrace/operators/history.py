"""Transaction histories of several sources merged into one readable timeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabtrace.functions.text import clean_comment, fallback_text, mes_text
from fabtrace.functions.time import parse_timestamp
from fabtrace.sources.schemas import HISTORY_FALLBACK

COLUMNS = [
    "TRANS_TIMESTAMP", "OPERATION", "TRANSACTION", "UPS", "EQUIPMENT", "OPERATOR_ID",
    "COMMENTTEXT", "TEXT",
]
SHOWN = ["TRANS_TIMESTAMP", "TRANSACTION", "OPERATION", "UPS", "EQUIPMENT", "OPERATOR_ID", "TEXT"]

MES = "mes"


def _time(df: DataFrame, name: str) -> Column:
    return parse_timestamp(name) if df.schema[name].dataType.typeName() == "string" else F.col(name)


# Columns only the execution-system history has.
MES_ONLY = [
    "is_reserved", "is_reserved_machine", "is_reserved_operator", "quantity_1", "hold_code",
    "hold_comment",
]


def mes_records(history: DataFrame) -> DataFrame:
    """Execution-system history under the common names, texts not built yet."""
    c = F.col
    return history.select(
        c("lot_number").alias("LOT"),
        _time(history, "trans_timestamp").alias("TRANS_TIMESTAMP"),
        c("operation").alias("OPERATION"),
        c("transaction").alias("TRANSACTION"),
        c("current_sip").alias("UPS"),
        c("actual_entity").alias("EQUIPMENT"),
        c("operator_id").alias("OPERATOR_ID"),
        c("commenttext").alias("COMMENTTEXT"),
        *MES_ONLY,
        F.lit(True).alias("is_mes"),
    )


def fallback_records(history: DataFrame) -> DataFrame:
    """A fallback history under the common names, texts not built yet."""
    c = F.col
    return history.select(
        c("lot").alias("LOT"),
        _time(history, "time_stamp").alias("TRANS_TIMESTAMP"),
        c("operation").alias("OPERATION"),
        c("transcode").alias("TRANSACTION"),
        c("sps_number").alias("UPS"),
        c("equipment").alias("EQUIPMENT"),
        c("operator").alias("OPERATOR_ID"),
        c("transaction_comment").alias("COMMENTTEXT"),
        *[F.lit(None).cast("string").alias(n) for n in MES_ONLY],
        F.lit(False).alias("is_mes"),
    )


def with_text(records: DataFrame, oracle_empty_is_null: bool = False) -> DataFrame:
    """The unified columns, with the lot first, of records of either kind."""
    c = F.col
    code, who, comment = c("TRANSACTION"), c("OPERATOR_ID"), c("COMMENTTEXT")
    of_mes = mes_text(
        code,
        who,
        comment,
        c("EQUIPMENT"),
        c("is_reserved"),
        c("is_reserved_machine"),
        c("is_reserved_operator"),
        c("quantity_1"),
        c("hold_code"),
        c("hold_comment"),
        oracle_empty_is_null,
    )
    of_fallback = fallback_text(code, who, comment, oracle_empty_is_null)
    shown = {
        "COMMENTTEXT": F.when(c("is_mes"), comment).otherwise(clean_comment(comment)),
        "TEXT": F.when(c("is_mes"), of_mes).otherwise(of_fallback),
    }
    return records.select("LOT", *[shown.get(n, c(n)).alias(n) for n in COLUMNS])


def mes_rows(history: DataFrame, oracle_empty_is_null: bool = False) -> DataFrame:
    """Execution-system history in the unified columns, with the lot first."""
    return with_text(mes_records(history), oracle_empty_is_null)


def fallback_rows(history: DataFrame, oracle_empty_is_null: bool = False) -> DataFrame:
    """A fallback history in the unified columns, with the lot first."""
    return with_text(fallback_records(history), oracle_empty_is_null)


def union_history(
    sources: Mapping[str, DataFrame | None],
    wanted: DataFrame | None = None,
    oracle_empty_is_null: bool = False,
) -> DataFrame:
    """One row per (lot, time, operation, transaction), from the first source that has it.

    ``sources`` is in priority order; the one called ``mes`` has the execution-system layout
    and a source that is not available is None; without any the result is empty.  ``wanted``
    (LOT, OPERATION) limits the rows.  Texts are built last, for the rows that remain.
    """
    parts = [
        (mes_records if name == MES else fallback_records)(df).withColumn("_rank", F.lit(rank))
        for rank, (name, df) in enumerate(sources.items())
        if df is not None
    ]
    if not parts:
        empty = SparkSession.active().createDataFrame([], HISTORY_FALLBACK)
        parts = [fallback_records(empty).withColumn("_rank", F.lit(0))]
    merged = reduce(DataFrame.unionByName, parts)
    if wanted is not None:
        merged = merged.join(wanted, ["LOT", "OPERATION"], "left_semi")
    key = ["LOT", "TRANS_TIMESTAMP", "OPERATION", "TRANSACTION"]
    rest = ["COMMENTTEXT", "UPS", "EQUIPMENT", "OPERATOR_ID", *MES_ONLY]
    # The first row of a group is also taken before the shuffle, so copies do not travel.
    first = Window.partitionBy(*key).orderBy("_rank", *[F.col(c).asc_nulls_last() for c in rest])
    kept = merged.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1)
    return with_text(kept, oracle_empty_is_null)


def in_time_order(history: DataFrame) -> DataFrame:
    """Latest first within each lot, unknown times last; shown columns only."""
    return history.orderBy(
        "LOT", F.col("TRANS_TIMESTAMP").desc_nulls_last(), "OPERATION", "TRANSACTION"
    ).select("LOT", *SHOWN)


def operations_to_show(summary: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """Delayed operations of each lot, or the opened one (LOT, OPERATION) for lots without any."""
    delayed = summary.select("LOT", "OPERATION")
    if opened is None:
        return delayed
    both = delayed.withColumn("_delayed", F.lit(True)).unionByName(
        opened.select("LOT", "OPERATION").distinct().withColumn("_delayed", F.lit(False))
    )
    # A lot has at most its operations here, so the window stays small.
    any_delayed = F.max("_delayed").over(Window.partitionBy("LOT"))
    return (
        both.withColumn("_any", any_delayed)
        .where(F.col("_delayed") == F.col("_any"))
        .select("LOT", "OPERATION")
    )


def of_operation(history: DataFrame, operations: Sequence[str]) -> DataFrame:
    """Rows of the given operations; none given means no rows."""
    return history.where(F.col("OPERATION").isin(list(operations)))
