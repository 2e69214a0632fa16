"""Planned against actual: the lot monitor and what is derived from it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabtrace.functions.time import days_between
from fabtrace.operators import holds, matching, moves, route
from fabtrace.operators.ordered import with_group_value
from fabtrace.operators.route import SEQ

DELAY_THRESHOLD = -0.5

# Columns of the monitor, in order.
MONITOR_COLUMNS = [
    "LOT", "OPERATION", "OPERATION_DESC", "OPTIONAL_OPER_FLAG", "STORE_FLAG", "TARGET_CT",
    "ACTUAL_CT", "DELAY", "WAITTIME", "TARGET_WAITTIME", "TRANS_TIME", "FF_TO_TARGET",
    "SPS_NUMBER", "EQUIPMENT", "EQUIPMENT_DESC", "RPT", "AMOUNT", "UNIT", "REWORK",
    "HOT_LOT_FLAG", "HOT_OPER_FLAG", "SUPER_HOT_FLAG", "FACILITY", "ROUTE", "TRANSCODE",
    "COST_CENTER", "WORK_CENTER", "HOLD_TIME_HRS",
]

# Column names of the basic variant, by monitor column.
BASIC_COLUMNS = {
    "LOT": "LOT",
    "OPERATION": "OPERATION",
    "OPERATION_DESC": "Operation_Desc",
    "OPTIONAL_OPER_FLAG": "Optional_Oper_Flag",
    "STORE_FLAG": "Store_Oper_Flag",
    "TARGET_CT": "Target_Ct",
    "ACTUAL_CT": "Actual_Ct",
    "WAITTIME": "WAITTIME",
    "TARGET_WAITTIME": "Target_Waittime",
    "TRANS_TIME": "Time_Stamp",
    "FF_TO_TARGET": "FF_To_TargetFF",
    "SPS_NUMBER": "Sps_Number",
    "EQUIPMENT": "EQUIPMENT",
    "EQUIPMENT_DESC": "Equipment_Description",
    "RPT": "RPT",
    "AMOUNT": "AMOUNT",
    "UNIT": "UNIT",
    "REWORK": "REWORK",
    "HOT_LOT_FLAG": "Hot_Lot_Flag",
    "HOT_OPER_FLAG": "Hot_Oper_Flag",
    "SUPER_HOT_FLAG": "Super_Hot_Flag",
    "FACILITY": "FACILITY",
    "ROUTE": "ROUTE",
    "TRANSCODE": "TRANSCODE",
    "COST_CENTER": "Cost_Center",
    "WORK_CENTER": "Work_Center",
}

# Columns kept for ordering and tie-breaking, not shown.
HIDDEN = [SEQ, "route_order_seq"]


@dataclass(frozen=True)
class LotTables:
    """The tables the monitor reads."""

    transactions: DataFrame
    route_operations: DataFrame
    operations: DataFrame
    equipment: DataFrame
    parameters: DataFrame

    def of_lots(self, lots: DataFrame) -> LotTables:
        """The same tables for the requested lots only (column ``lot``)."""
        return replace(self, transactions=self.transactions.join(lots.select("lot"), "lot", "left_semi"))

    def of_lot(self, lot: str) -> LotTables:
        return replace(self, transactions=self.transactions.where(F.col("lot") == lot))


def visits(
    tables: LotTables, as_of: dt.datetime, hold_time: bool = True, one_version: bool = False
) -> DataFrame:
    """One row per planned operation visit and move, for all lots."""
    tx = tables.transactions
    # The segments feed both the planned operations and the moves. Rows without a lot are
    # left out first, in every branch alike, so that the two copies share their shuffle.
    known = tx.where(F.col("lot").isNotNull())
    segments = route.route_segments(route.boundary_moves(known, tables.route_operations, one_version), as_of)
    planned = route.route_master(segments, tables.route_operations, tables.operations, one_version)
    made = moves.timed_moves(known, segments)
    if hold_time:
        made = holds.with_hold_time(made, holds.hold_history(known, tables.parameters))
    else:
        made = made.repartition("lot", "operation")
    made = moves.with_equipment(made, tables.equipment)
    return _measured(matching.match_moves(made, planned), hold_time)


def _measured(matched: DataFrame, hold_time: bool) -> DataFrame:
    keys = [
        "r_lot", "r_operation", "r_facility", "r_route", "r_route_key", "r_route_order_seq", f"r_{SEQ}",
        "r_operation_desc", "r_store_flag", "r_optional_oper_flag",
        "l_lot", "l_operation", "l_facility", "l_route", "l_to_operation", "l_trans_time",
        "l_transcode", "l_cost_center", "l_work_center", "l_qty_out_1", "l_unit_1",
        "l_equipment", "l_equipment_description", "l_sps_number", "l_rework_flag",
        "l_hot_lot_flag", "l_hot_oper_flag", "l_super_hot_flag",
    ]
    target = F.sum(F.coalesce("l_due_cycle_time", "r_due_ct"))
    measures = {
        "_target": target,
        "_actual": F.sum("l_cycle_time"),
        "_wait": F.sum("l_wt"),
        "_target_wait": F.sum(F.coalesce("l_due_wait_time", "r_queue_cycle_time")),
        "_in_operation": F.sum(days_between("l_enter_op_ts", "l_trans_time")),
    }
    if hold_time:
        measures["_held"] = F.sum("l_actual_holdtime")
    grouped = matched.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    with_rpt = with_group_value(
        grouped,
        ["r_lot", "r_operation", "l_facility", "l_route", "l_sps_number"],
        F.avg("_actual"),
        "_rpt",
    )
    c = F.col
    out = {
        "LOT": c("r_lot"),
        "OPERATION": c("r_operation"),
        "OPERATION_DESC": c("r_operation_desc"),
        "OPTIONAL_OPER_FLAG": c("r_optional_oper_flag"),
        "STORE_FLAG": F.coalesce(c("r_store_flag"), F.when(c("l_operation") < "1000", "Y").otherwise("N")),
        "TARGET_CT": F.round("_target", 4),
        "ACTUAL_CT": F.round("_actual", 4),
        "WAITTIME": F.round("_wait", 4),
        "TARGET_WAITTIME": F.round("_target_wait", 4),
        "TRANS_TIME": c("l_trans_time"),
        "FF_TO_TARGET": F.round(_ratio(c("_in_operation"), c("_target")), 4),
        "SPS_NUMBER": c("l_sps_number"),
        "EQUIPMENT": c("l_equipment"),
        "EQUIPMENT_DESC": c("l_equipment_description"),
        "RPT": F.round("_rpt", 4),
        "AMOUNT": c("l_qty_out_1"),
        "UNIT": c("l_unit_1"),
        "REWORK": c("l_rework_flag"),
        "HOT_LOT_FLAG": F.coalesce(c("l_hot_lot_flag"), F.lit("N")),
        "HOT_OPER_FLAG": F.coalesce(c("l_hot_oper_flag"), F.lit("N")),
        "SUPER_HOT_FLAG": F.coalesce(c("l_super_hot_flag"), F.lit("N")),
        "FACILITY": c("r_facility"),
        "ROUTE": F.coalesce(
            c("l_route"),
            c("r_route"),
            F.when(c("r_store_flag") == "Y", "store").otherwise(c("r_operation_desc")),
        ),
        "TRANSCODE": c("l_transcode"),
        "COST_CENTER": c("l_cost_center"),
        "WORK_CENTER": c("l_work_center"),
        **({"HOLD_TIME_HRS": F.round(c("_held") * 24, 4)} if hold_time else {}),
        SEQ: c(f"r_{SEQ}"),
        "route_order_seq": c("r_route_order_seq"),
    }
    return with_rpt.select(*[e.alias(n) for n, e in out.items()])


def _ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 1 where ``whole`` is zero."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def with_delay(visited: DataFrame) -> DataFrame:
    """Target minus actual days; negative means late."""
    delay = F.coalesce("TARGET_CT", F.lit(0.0)) - F.coalesce("ACTUAL_CT", F.lit(0.0))
    return visited.withColumn("DELAY", F.round(delay, 4))


def drop_covered(visited: DataFrame) -> DataFrame:
    """Drop planned rows without a move where the lot visited that operation elsewhere."""
    flagged = with_group_value(visited, ["LOT", "OPERATION"], F.max(F.col("ACTUAL_CT").isNotNull()), "_seen")
    return flagged.where(F.col("ACTUAL_CT").isNotNull() | ~F.col("_seen")).drop("_seen")


def lot_monitor(
    tables: LotTables, as_of: dt.datetime, keep_order: bool = False, one_version: bool = False
) -> DataFrame:
    """How late each lot is at each operation of its planned route.

    ``keep_order`` adds the hidden ordering columns. ``one_version`` takes one version of a
    planned operation as of the day instead of all of them.
    """
    rows = drop_covered(with_delay(visits(tables, as_of, one_version=one_version)))
    return rows.select(*MONITOR_COLUMNS, *(HIDDEN if keep_order else []))


def in_report_order(monitor: DataFrame) -> DataFrame:
    """By lot, planned step and time; takes the monitor with its ordering columns."""
    ordered = monitor.orderBy(
        "LOT", F.col(SEQ).asc_nulls_last(), F.col("TRANS_TIME").asc_nulls_last()
    )
    return ordered.drop(*HIDDEN)


def lot_monitor_basic(tables: LotTables, as_of: dt.datetime) -> DataFrame:
    """The monitor without delay, hold hours and the covered-row filter, by lot and time."""
    rows = visits(tables, as_of, hold_time=False)
    renamed = rows.select(*[F.col(k).alias(v) for k, v in BASIC_COLUMNS.items()])
    return renamed.orderBy("LOT", F.col("Time_Stamp").asc_nulls_last())


def delay_summary(monitor: DataFrame, threshold: float = DELAY_THRESHOLD) -> DataFrame:
    """Operations of each lot whose delays sum to the threshold or less.

    Takes the monitor with its ordering columns: the description shown is the first one.
    """
    place = F.struct(F.col(SEQ).isNull(), SEQ, F.col("TRANS_TIME").isNull(), "TRANS_TIME", "OPERATION_DESC")
    summed = monitor.groupBy("LOT", "OPERATION").agg(
        F.min_by("OPERATION_DESC", F.when(F.col("OPERATION_DESC").isNotNull(), place)).alias("OPERATION_DESC"),
        F.round(F.sum("DELAY"), 4).alias("SUM_DELAY"),
        F.count("DELAY").alias("COUNT"),
    )
    return summed.where(F.col("SUM_DELAY") <= threshold)


def top_delays(summary: DataFrame, k: int) -> DataFrame:
    """The ``k`` latest (lot, operation) pairs."""
    return summary.orderBy("SUM_DELAY", "LOT", "OPERATION").limit(k)


def jump_list(summary: DataFrame) -> DataFrame:
    """Delayed operations of each lot, latest first, with their label."""
    label = F.concat_ws("", "OPERATION", F.lit(" — "), "OPERATION_DESC")
    return summary.select("LOT", "OPERATION", "SUM_DELAY", label.alias("LABEL")).orderBy(
        "LOT", "SUM_DELAY", "OPERATION"
    )


def lot_kpis(monitor: DataFrame) -> DataFrame:
    """Rows, first route, first facility and total actual cycle time of each lot.

    Takes the monitor with its ordering columns.
    """
    place = [F.col(SEQ).isNull(), F.col(SEQ), F.col("TRANS_TIME").isNull(), F.col("TRANS_TIME")]

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.struct(*place, F.col(name)))).alias(name)

    return monitor.groupBy("LOT").agg(
        F.count("*").alias("TOTAL_OPERATIONS"),
        first("ROUTE"),
        first("FACILITY"),
        F.round(F.sum("ACTUAL_CT"), 4).alias("TOTAL_ACTUAL_CT"),
    )
