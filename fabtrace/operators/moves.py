"""Moves out of an operation, with cycle and wait times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabtrace.functions.time import days_between
from fabtrace.operators.ordered import By, Earlier, Prev, Running, with_ordered

ORDER = ["time_stamp", "operation", "to_operation", "transcode"]


def timed_moves(transactions: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Undeleted moves of known lots; times count from the previous move, else from entering the operation.

    With ``segments``, ``segment_start`` is the start of the latest one of the lot at or before
    the move.  Segments of a lot follow each other, so an equality on this column replaces the
    interval test of the route join.
    """
    kept = transactions.where(
        F.col("lot").isNotNull()
        & (F.col("operation") != F.col("to_operation"))
        & (F.col("deleted_flag") != "Y")
    )
    if segments is None:
        ordered = with_ordered(kept, ORDER, By(["lot"], {"_prev": Prev("time_stamp")}))
    else:
        ordered = _among_segments(kept, segments)
    since = F.coalesce("_prev", "enter_operation_time_stamp")
    return ordered.select(
        "lot",
        "facility",
        "route",
        "operation",
        "to_operation",
        F.col("time_stamp").alias("trans_time"),
        "transcode",
        "qty_out_1",
        "unit_1",
        "equipment",
        "work_center",
        "cost_center",
        "rework_flag",
        "hot_lot_flag",
        "hot_oper_flag",
        "super_hot_flag",
        F.col("enter_operation_time_stamp").alias("enter_op_ts"),
        "due_cycle_time",
        (F.col("due_cycle_time") - F.col("due_process_cycle_time")).alias("due_wait_time"),
        F.coalesce(days_between(since, F.col("time_stamp")), F.lit(0.0)).alias("cycle_time"),
        F.coalesce(days_between(since, F.col("movein_time_stamp")), F.lit(0.0)).alias("wt"),
        F.coalesce("sps_number", "main_sps").alias("sps_number"),
        *[c for c in ordered.columns if c == "segment_start"],
    )


def _among_segments(kept: DataFrame, segments: DataFrame) -> DataFrame:
    """Moves and segment starts in one time order, so that one sort gives both columns."""
    payload = T.StructType([f for f in kept.schema if f.name not in ("lot", *ORDER)])
    no_text = [F.lit(None).cast("string").alias(c) for c in ORDER[1:]]
    no_time = F.lit(None).cast("timestamp_ntz")
    starts = segments.select(
        "lot",
        F.col("route_order_seq").alias("time_stamp"),
        *no_text,
        F.lit(0).alias("_kind"),
        F.col("route_order_seq").alias("_start"),
        no_time.alias("_moved"),
        F.lit(None).cast(payload).alias("_rest"),
    )
    made = kept.select(
        "lot",
        *ORDER,
        F.lit(1).alias("_kind"),
        no_time.alias("_start"),
        F.col("time_stamp").alias("_moved"),
        F.struct(*payload.names).alias("_rest"),
    )
    stream = with_ordered(
        starts.unionByName(made),
        ["time_stamp", "_kind", *ORDER[1:]],
        By(["lot"], {"_prev": Earlier("_moved"), "segment_start": Running("last", "_start")}),
    )
    moved = stream.where(F.col("_kind") == 1)
    return moved.select("lot", *ORDER, "_rest.*", "_prev", "segment_start")


def with_equipment(moves: DataFrame, equipment: DataFrame) -> DataFrame:
    """Equipment description; the smallest one where a key has several."""
    described = equipment.groupBy(F.col("equipment").alias("_equipment")).agg(
        F.min("equipment_desc").alias("equipment_description")
    )
    return moves.join(described, F.col("equipment") == F.col("_equipment"), "left").drop("_equipment")


def actual_cycle_time(moves: DataFrame) -> DataFrame:
    """Total cycle and wait time of each lot at each operation."""
    return moves.groupBy("lot", "operation").agg(
        F.count("*").alias("moves"),
        F.round(F.sum("cycle_time"), 4).alias("actual_ct"),
        F.round(F.sum("wt"), 4).alias("waittime"),
    )
