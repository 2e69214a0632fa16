"""The planned route of each lot, rebuilt from the moves it made.

A lot's moves are cut into route segments: a segment starts where the lot enters another
route or steps back.  Each segment is then expanded to the planned operations it covers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabtrace.operators.ordered import By, Next, Prev, Running, with_ordered

NO_ROUTE = "n/a"
# Sequence numbers that stand for "no further step".
LAST_STEP = 9999
OPEN_END = 99999

SEQ = "operation_sequence_number"
# Time first; the rest only makes equal times deterministic.
ORDER = ["time_stamp", SEQ, "planned_operation", "facility"]


def in_force(route_operations: DataFrame) -> DataFrame:
    """Planned operations with the days each version is the one to take, for joins by day.

    A version counts after the day of the one before (``force_after``, null for the first) and
    up to its own; the latest one also stays in force (``force_until`` is null). So a day has
    one version, and an as-of join is a join on the operation and an interval. Of versions
    created together the first in the order of their values counts. Versions without a day are
    never in force.
    """
    key = ["facility", "route", "operation"]
    values = [F.col(c).asc_nulls_last() for c in route_operations.columns if c not in (*key, "create_date")]
    together = Window.partitionBy(*key, "create_date").orderBy(*values)
    dated = route_operations.where(F.col("create_date").isNotNull())
    single = dated.withColumn("_nth", F.row_number().over(together)).where("_nth = 1").drop("_nth")
    by_day = Window.partitionBy(*key).orderBy("create_date")
    return single.withColumns(
        {
            "force_after": F.lag("create_date").over(by_day),
            "force_until": F.when(F.lead("create_date").over(by_day).isNotNull(), F.col("create_date")),
        }
    )


def _is_in_force(day: Column) -> Column:
    after, until = F.col("force_after"), F.col("force_until")
    return (after.isNull() | (day > after)) & (until.isNull() | (day <= until))


def boundary_moves(transactions: DataFrame, route_operations: DataFrame, one_version: bool = False) -> DataFrame:
    """All moves with their planned step, and ``operation`` set only at segment boundaries.

    Rows without a lot belong to none and are left out.

    Several versions of a planned operation repeat the move, as many as were created on or
    after its day. With ``one_version`` it has the first of these only.
    """
    moves = transactions.where(F.col("lot").isNotNull() & (F.col("operation") != F.col("to_operation"))).select(
        "lot", "facility", "route", "operation", "time_stamp", "date_stamp"
    )
    planned = (in_force(route_operations) if one_version else route_operations).select(
        F.col("facility").alias("p_facility"),
        F.col("route").alias("p_route"),
        F.col("operation").alias("p_operation"),
        SEQ,
        "create_date",
        *(["force_after", "force_until"] if one_version else []),
    )
    right_day = F.col("date_stamp") <= F.col("create_date")
    if one_version:
        right_day = right_day & _is_in_force(F.col("date_stamp"))
    stepped = (
        moves.join(
            planned,
            (F.col("facility") == F.col("p_facility"))
            & (F.col("route") == F.col("p_route"))
            & (F.col("operation") == F.col("p_operation"))
            & right_day,
            "left",
        )
        .withColumn("_route", F.coalesce("p_route", F.lit(NO_ROUTE)))
        .withColumnRenamed("operation", "planned_operation")
    )
    by_route = with_ordered(
        stepped,
        ORDER,
        By(["lot"], {"_prev_route": Prev("_route", "prev"), "_next_route": Next("_route", "next")}),
        By(
            ["lot", "route"],
            {"_prev_seq": Prev(SEQ), "_next_seq": Next(SEQ), "loop_back_indicator": Running("max", SEQ)},
        ),
    )
    boundary = (
        (F.col("_route") != F.col("_prev_route"))
        | F.col("p_route").isNull()
        | (F.col("_route") != F.col("_next_route"))
        | (F.col(SEQ) > F.col("_next_seq"))
        | (F.col(SEQ) < F.col("_prev_seq"))
    )
    return by_route.select(
        "lot",
        "facility",
        "route",
        "time_stamp",
        F.when(boundary, F.col("planned_operation")).alias("operation"),
        SEQ,
        "loop_back_indicator",
    )


def route_segments(boundaries: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Segments of each lot with the steps and the time span they cover.

    The span is half open; the last segment of a lot ends one hour after ``as_of``, and one
    before a segment without a time has no end.
    """
    order = ["time_stamp", SEQ, "operation", "facility"]
    kept = boundaries.where(F.col("operation").isNotNull()).withColumn(
        "_route", F.coalesce("route", F.lit(NO_ROUTE))
    )
    by_route = with_ordered(
        kept,
        order,
        By(["lot"], {"_prev_route": Prev("_route", "prev"), "_prev_seq": Prev(SEQ)}),
        By(["lot", "route"], {"_next_seq": Next(SEQ, LAST_STEP)}),
    )
    starts = (
        by_route.withColumn("step_reached", F.coalesce("_next_seq", SEQ))
        .where((F.col("_route") != F.col("_prev_route")) | (F.col(SEQ) < F.col("_prev_seq")))
        .withColumns({"route_order_seq": F.col("time_stamp"), "_any": F.lit(True)})
        .drop("_prev_route", "_prev_seq", "_next_seq")
    )
    end_of_time = F.lit(as_of + dt.timedelta(hours=1)).cast("timestamp_ntz")
    next_step = with_ordered(
        starts,
        order,
        By(["lot"], {"_next_operation": Next("operation"), "_next": Next("_any"), "_next_start": Next("route_order_seq")}),
        By(["lot", "route"], {"_next_seq": Next(SEQ, OPEN_END)}),
    )
    return next_step.select(
        "lot",
        "facility",
        "route",
        "operation",
        "route_order_seq",
        SEQ,
        "loop_back_indicator",
        F.when(F.col("_next_seq") < F.col("step_reached"), F.col("step_reached"))
        .otherwise(F.col("_next_seq"))
        .alias("to_operation_sequence_number"),
        F.when(F.col("_next_operation").isNull(), OPEN_END)
        .otherwise(F.col("step_reached"))
        .alias("visited_until"),
        F.when(F.col("_next"), F.col("_next_start")).otherwise(end_of_time).alias("route_leave_time_stamp"),
    )


def route_master(
    segments: DataFrame, route_operations: DataFrame, operations: DataFrame, one_version: bool = False
) -> DataFrame:
    """Planned mandatory operations of every segment, with target times and descriptions.

    Every version of an operation is planned once more. With ``one_version`` it is the one in
    force on the day the segment begins.
    """
    planned = (in_force(route_operations) if one_version else route_operations).select(
        F.col("facility").alias("p_facility"),
        F.col("route").alias("p_route"),
        F.col("operation").alias("p_operation"),
        F.col(SEQ).alias("p_seq"),
        "process_cycle_time",
        "queue_cycle_time",
        "optional_oper_flag",
        *(["force_after", "force_until"] if one_version else []),
    )
    began = F.date_trunc("day", "route_order_seq").cast("timestamp_ntz")
    described = operations.select(
        F.col("facility").alias("o_facility"),
        F.col("operation").alias("o_operation"),
        "operation_long_desc",
        "operation_short_desc",
        "store_flag_rep",
    )
    covered = (
        segments.join(
            planned,
            (F.col("facility") == F.col("p_facility"))
            & (F.col("route") == F.col("p_route"))
            & (F.col("p_seq") >= F.col(SEQ))
            & (F.col("p_seq") < F.col("to_operation_sequence_number"))
            & (_is_in_force(began) if one_version else F.lit(True)),
            "left",
        )
        .where(F.coalesce("optional_oper_flag", F.lit("N")) == "N")
        .withColumn("_facility", F.coalesce("p_facility", "facility"))
        .withColumn("_operation", F.coalesce("p_operation", "operation"))
    )
    # Steps below the highest one already reached are a loop back and carry no target.
    looped = F.col("loop_back_indicator") > F.col("p_seq")
    due = F.round(F.col("process_cycle_time") + F.col("queue_cycle_time"), 3)
    return covered.join(
        described,
        (F.col("_facility") == F.col("o_facility")) & (F.col("_operation") == F.col("o_operation")),
        "left",
    ).select(
        "lot",
        "facility",
        "route",
        F.col("_operation").alias("operation"),
        F.col("store_flag_rep").alias("store_flag"),
        F.col("p_seq").alias(SEQ),
        F.when(F.col("p_seq") > F.col("visited_until"), "Y").otherwise("N").alias("is_off_route"),
        F.coalesce("operation_long_desc", "operation_short_desc", F.lit("??")).alias("operation_desc"),
        F.when(looped, None).otherwise(F.col("queue_cycle_time")).alias("queue_cycle_time"),
        F.when(looped, None).otherwise(due).alias("due_ct"),
        "route_order_seq",
        "route_leave_time_stamp",
        F.coalesce("optional_oper_flag", F.lit("N")).alias("optional_oper_flag"),
    )
