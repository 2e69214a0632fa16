"""Hold releases and the hold time that falls inside each stay at an operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabtrace.functions.time import MICROS_PER_DAY, days_between, micros_between
from fabtrace.operators.ordered import By, Prev, Running, with_group_value, with_ordered

# Parameter names under which the transaction codes are listed.
HOLD_START = "HOLD START TRANSACTION"
HOLD_RELEASE = "HOLD RELEASE TRANSACTION"

PLACE = ["lot", "facility", "route", "operation"]


def hold_history(transactions: DataFrame, parameters: DataFrame) -> DataFrame:
    """Releases with the time since the previous hold event at the same place.

    That event may be a release too; the first event of a place has no hold time.
    """

    # One row per code, so the join keeps or drops events and never repeats them.
    codes = (
        parameters.where(F.col("var_name").isin(HOLD_START, HOLD_RELEASE))
        .groupBy(F.col("var_value").alias("transcode"))
        .agg(F.max(F.col("var_name") == HOLD_RELEASE).alias("is_release"))
    )
    events = (
        transactions.where(F.col("lot").isNotNull() & (F.col("deleted_flag") != "Y"))
        .select(*PLACE, "transcode", "time_stamp")
        .join(codes, "transcode")
    )
    ordered = with_ordered(
        events.repartition("lot", "operation"),
        ["time_stamp", "transcode"],
        By(PLACE, {"hllt_time_stamp": Prev("time_stamp")}),
    )
    return ordered.where("is_release").select(
        *PLACE,
        "transcode",
        F.col("time_stamp").alias("rllt_time_stamp"),
        days_between("hllt_time_stamp", "time_stamp").alias("actual_holdtime"),
        micros_between("hllt_time_stamp", "time_stamp").alias("hold_micros"),
    )


def with_hold_time(moves: DataFrame, releases: DataFrame) -> DataFrame:
    """Add ``actual_holdtime``: days of the releases within [enter_op_ts, trans_time].

    Works in time linear in moves and releases, without pairing them: running totals of hold
    time are read where a stay begins and where it ends, and subtracted.  Totals are whole
    microseconds, so the difference is exact.  A stay without begin or end has no hold time.
    """
    # The place columns stay outside the payload, so their partitioning is kept.
    columns = [c for c in moves.columns if c not in PLACE]
    moves = moves.repartition("lot", "operation")
    payload = T.StructType([moves.schema[c] for c in columns])
    # Within equal times: a stay begins (0), releases happen (1), a stay ends (2).
    probes = moves.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(2)))).select(
        *PLACE,
        F.when(F.col("_side") == 0, F.col("enter_op_ts")).otherwise(F.col("trans_time")).alias("_at"),
        "_side",
        F.col("enter_op_ts").alias("_enter"),
        F.col("trans_time").alias("_leave"),
        F.when(F.col("_side") == 2, F.struct(*columns)).alias("_move"),
        F.lit(None).cast("bigint").alias("hold_micros"),
    )
    released = releases.select(
        *PLACE,
        F.col("rllt_time_stamp").alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("timestamp_ntz").alias("_enter"),
        F.lit(None).cast("timestamp_ntz").alias("_leave"),
        F.lit(None).cast(payload).alias("_move"),
        "hold_micros",
    )
    totals = with_ordered(
        probes.unionByName(released),
        ["_at", "_side"],
        By(PLACE, {"_sum": Running("sum", "hold_micros"), "_n": Running("count", "hold_micros")}),
    )
    begin = F.when(F.col("_side") == 0, F.struct("_sum", "_n"))
    stay = [*PLACE, "_enter", "_leave"]
    paired = with_group_value(
        totals.where(F.col("_side") != 1), stay, F.max(begin), "_begin"
    ).where(F.col("_side") == 2)
    held = F.when(
        # A null place equals nothing, and neither does a null time.
        F.col("lot").isNotNull()
        & F.col("facility").isNotNull()
        & F.col("route").isNotNull()
        & F.col("_enter").isNotNull()
        & F.col("_leave").isNotNull()
        & (F.col("_n") > F.col("_begin._n")),
        (F.col("_sum") - F.coalesce("_begin._sum", F.lit(0))) / F.lit(float(MICROS_PER_DAY)),
    )
    return paired.select(*PLACE, "_move.*", held.alias("actual_holdtime"))

