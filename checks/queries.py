"""Every operator run on the driver's tables."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derive
from fabtrace.functions import display
from fabtrace.operators import (
    annotations,
    history,
    holds,
    moves,
    orders,
    paging,
    profiles,
    quality,
    route,
    trees,
    workbook,
)
from fabtrace.plans import detail, monitor, stored
from fabtrace.session import tune
from fabtrace.sources import annotations as annotation_records
from fabtrace.sources import files, payload, tables
from fabtrace.sources import workbook as sheets
from fabtrace.sources.scratch import new_path
from fabtrace.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(tune(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def _boundaries(t: monitor.LotTables) -> DataFrame:
    return route.boundary_moves(t.transactions, t.route_operations)


def _held(t: monitor.LotTables) -> DataFrame:
    releases = holds.hold_history(t.transactions, t.parameters)
    return holds.with_hold_time(moves.timed_moves(t.transactions), releases)


# ---- lot monitor -----------------------------------------------------------------------


@query
def actual_cycle_time(spark, sf_dir):
    t = derive.lot_tables(spark, sf_dir)
    return moves.actual_cycle_time(moves.timed_moves(t.transactions))


@query
def boundary_moves(spark, sf_dir):
    t = derive.lot_tables(spark, sf_dir)
    return _boundaries(t)


@query
def route_segments(spark, sf_dir):
    t = derive.lot_tables(spark, sf_dir)
    return route.route_segments(_boundaries(t), derive.AS_OF)


@query
def route_master(spark, sf_dir):
    t = derive.lot_tables(spark, sf_dir)
    segments = route.route_segments(_boundaries(t), derive.AS_OF)
    return route.route_master(segments, t.route_operations, t.operations)


@query
def hold_history(spark, sf_dir):
    t = derive.lot_tables(spark, sf_dir)
    return holds.hold_history(t.transactions, t.parameters).drop("hold_micros")


@query
def hold_time_in_operation(spark, sf_dir):
    held = _held(derive.lot_tables(spark, sf_dir))
    return held.where(F.col("actual_holdtime").isNotNull()).select(
        "lot", "operation", "enter_op_ts", "trans_time", F.round("actual_holdtime", 6).alias("holdtime")
    )


@query
def valid_moves(spark, sf_dir):
    t = derive.lot_tables(spark, sf_dir)
    timed = moves.with_equipment(_held(t), t.equipment)
    return timed.withColumns({c: F.round(c, 6) for c in ("cycle_time", "wt", "actual_holdtime", "due_wait_time")})


def _monitor(spark, sf_dir) -> DataFrame:
    return monitor.lot_monitor(derive.lot_tables(spark, sf_dir), derive.AS_OF, keep_order=True)


@query
def lot_monitor(spark, sf_dir):
    return _monitor(spark, sf_dir).drop(*monitor.HIDDEN)


@query
def lot_monitor_ordered(spark, sf_dir):
    return monitor.in_report_order(_monitor(spark, sf_dir))


@query
def lot_monitor_basic(spark, sf_dir):
    return monitor.lot_monitor_basic(derive.lot_tables(spark, sf_dir), derive.AS_OF)


@query
def lot_monitor_for_lots(spark, sf_dir):
    wanted = workbook.lots_from_text(derive.lot_requests(spark, sf_dir), "lots")
    tables = derive.lot_tables(spark, sf_dir).of_lots(wanted)
    return monitor.lot_monitor(tables, derive.AS_OF)


@query
def lot_monitor_one_lot(spark, sf_dir):
    return monitor.lot_monitor(derive.lot_tables(spark, sf_dir).of_lot("VA000007"), derive.AS_OF)


@query
def ff_to_target(spark, sf_dir):
    visited = monitor.visits(derive.lot_tables(spark, sf_dir), derive.AS_OF, hold_time=False)
    return visited.select("LOT", "OPERATION", "TRANS_TIME", "TARGET_CT", "FF_TO_TARGET")


@query
def rpt_by_operation(spark, sf_dir):
    visited = monitor.visits(derive.lot_tables(spark, sf_dir), derive.AS_OF, hold_time=False)
    keys = ["LOT", "FACILITY", "ROUTE", "OPERATION", "SPS_NUMBER", "RPT"]
    return visited.where(F.col("RPT").isNotNull()).select(*keys).distinct()


@query
def delay_summary(spark, sf_dir):
    return monitor.delay_summary(_monitor(spark, sf_dir))


@query
def top_delays(spark, sf_dir):
    return monitor.top_delays(monitor.delay_summary(_monitor(spark, sf_dir)), 20)


@query
def jump_list(spark, sf_dir):
    return monitor.jump_list(monitor.delay_summary(_monitor(spark, sf_dir)))


@query
def lot_kpis(spark, sf_dir):
    return monitor.lot_kpis(_monitor(spark, sf_dir))


def _versioned(spark, sf_dir) -> monitor.LotTables:
    planned = derive.versioned_route_operations(spark, sf_dir)
    return dataclasses.replace(derive.lot_tables(spark, sf_dir), route_operations=planned)


@query
def boundary_moves_one_version(spark, sf_dir):
    t = _versioned(spark, sf_dir)
    return route.boundary_moves(t.transactions, t.route_operations, one_version=True)


@query
def route_master_one_version(spark, sf_dir):
    t = _versioned(spark, sf_dir)
    bounds = route.boundary_moves(t.transactions, t.route_operations, one_version=True)
    segments = route.route_segments(bounds, derive.AS_OF)
    return route.route_master(segments, t.route_operations, t.operations, one_version=True)


def _kept_monitor(spark, sf_dir) -> DataFrame:
    """Built of what was known before, then brought up to date."""
    root, now = new_path(spark, "monitor"), derive.lot_tables(spark, sf_dir)
    before = dataclasses.replace(now, transactions=derive.earlier_transactions(spark, sf_dir))
    stored.refresh(before, dt.datetime(2024, 1, 22), root)
    stored.refresh(now, derive.AS_OF, root)
    return stored.read(spark, root)


@query
def lot_monitor_refreshed(spark, sf_dir):
    return _kept_monitor(spark, sf_dir).drop(*monitor.HIDDEN)


@query
def lot_kpis_of_kept_monitor(spark, sf_dir):
    return monitor.lot_kpis(_kept_monitor(spark, sf_dir))


@query
def delayed_history_of_kept_monitor(spark, sf_dir):
    summary = monitor.delay_summary(_kept_monitor(spark, sf_dir))
    opened = derive.annotation_keys(spark, sf_dir).select(
        F.col("lot").alias("LOT"), F.col("op").alias("OPERATION")
    )
    return detail.delayed_history(summary, derive.history_sources(spark, sf_dir), opened)


# ---- history ---------------------------------------------------------------------------


def _coded(spark, sf_dir, codes: list[str]) -> DataFrame:
    recorded = derive.recorded_events(spark, sf_dir)
    return recorded.withColumn("transcode", derive._pick(F.col("event_id") % len(codes), codes))


@query
def history_text_mes(spark, sf_dir):
    return history.mes_rows(derive.history_mes(_coded(spark, sf_dir, derive.MES_CODES)))


@query
def history_text_mes_literal(spark, sf_dir):
    coded = derive.history_mes(_coded(spark, sf_dir, derive.MES_CODES))
    return history.mes_rows(coded, oracle_empty_is_null=True)


@query
def history_text_fallback(spark, sf_dir):
    return history.fallback_rows(derive.history_fallback(_coded(spark, sf_dir, derive.FALLBACK_CODES)))


@query
def history_unified(spark, sf_dir):
    merged = history.union_history(derive.history_sources(spark, sf_dir))
    return history.in_time_order(merged)


@query
def history_text_times(spark, sf_dir):
    recorded = derive.recorded_events(spark, sf_dir)
    written = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.col("time_stamp").cast("string"))
    source = derive.history_fallback(recorded.withColumn("time_stamp", written))
    merged = history.union_history({"only": source, "gone": None})
    return merged.select("LOT", "TRANS_TIMESTAMP", "OPERATION", "TRANSACTION")


@query
def delayed_history(spark, sf_dir):
    summary = monitor.delay_summary(_monitor(spark, sf_dir))
    opened = derive.annotation_keys(spark, sf_dir).select(
        F.col("lot").alias("LOT"), F.col("op").alias("OPERATION")
    )
    return detail.delayed_history(summary, derive.history_sources(spark, sf_dir), opened)


@query
def history_one_operation(spark, sf_dir):
    merged = history.union_history(derive.history_sources(spark, sf_dir))
    return history.of_operation(merged, ["991"])


# ---- orders ----------------------------------------------------------------------------


@query
def orders_from_payload(spark, sf_dir):
    return payload.orders_from_payload(derive.order_payloads(spark, sf_dir))


@query
def payload_errors(spark, sf_dir):
    bad = payload.payload_errors(derive.order_payloads(spark, sf_dir))
    return bad.withColumn("keys_found", F.array_join("keys_found", ","))


def _board(spark, sf_dir) -> DataFrame:
    return orders.board(derive.priority_orders(spark, sf_dir), keep=["ordinal"])


def _ingested_board(spark, sf_dir) -> DataFrame:
    """The board of what the payloads hold, in arrival order."""
    landed = payload.orders_from_payload(derive.order_payloads(spark, sf_dir))
    place = F.col("payload_id") * 2 + F.col("pos")
    return orders.board(landed.withColumn("ordinal", place), keep=["ordinal"])


@query
def order_board(spark, sf_dir):
    return orders.cells(_ingested_board(spark, sf_dir), keep=["ordinal"])


@query
def order_board_zero_as_none(spark, sf_dir):
    return orders.cells(_board(spark, sf_dir), keep=["ordinal"], python_falsy=True)


@query
def order_owners(spark, sf_dir):
    return orders.owners(_board(spark, sf_dir))


@query
def orders_by_owner(spark, sf_dir):
    return orders.of_owners(_board(spark, sf_dir))


@query
def orders_search(spark, sf_dir):
    return orders.search_lots(_board(spark, sf_dir), " va0+1[02] ")


@query
def orders_search_literal(spark, sf_dir):
    return orders.search_lots(_board(spark, sf_dir), " va0001", literal=True)


@query
def orders_by_parameter(spark, sf_dir):
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("landed_orders")
    text = "SELECT o_orderkey, o_totalprice FROM landed_orders WHERE o_orderstatus = :status"
    return tables.query(spark, text, status="F")


FACET_CHOICE = {
    "Order Status": ["Confirmed", "Warning"],
    "Priority": None,
    "Wafer Size": ["200", "300"],
    "Owner": ["DEVT", "unknown", "PROD"],
}


@query
def orders_faceted(spark, sf_dir):
    return orders.of_facets(_board(spark, sf_dir), FACET_CHOICE)


@query
def order_facets(spark, sf_dir):
    return orders.facets(_board(spark, sf_dir))


@query
def facet_option_search(spark, sf_dir):
    return orders.search_options(orders.facets(_board(spark, sf_dir)), "R1")


@query
def order_status_kpi(spark, sf_dir):
    return orders.status_tiles(orders.of_owners(_board(spark, sf_dir)))


@query
def order_status_counts(spark, sf_dir):
    return orders.status_counts(_board(spark, sf_dir))


@query
def order_pages(spark, sf_dir):
    return paging.with_page(orders.of_owners(_board(spark, sf_dir)), ["ordinal"])


@query
def order_page(spark, sf_dir):
    return paging.page_of(orders.of_owners(_board(spark, sf_dir)), ["ordinal"], 2)


@query
def order_pages_by_text(spark, sf_dir):
    """Latest delivery first, orders without one at the end; few different texts."""
    board = _board(spark, sf_dir)
    return paging.with_page(board, ["Current Delivery", "External Order"], descending=["Current Delivery"])


@query
def history_pages(spark, sf_dir):
    """All lots' history in one order of time, latest first."""
    merged = history.union_history(derive.history_sources(spark, sf_dir))
    return paging.with_page(
        merged.select("LOT", *history.SHOWN), ["TRANS_TIMESTAMP", "LOT", "OPERATION", "TRANSACTION"], descending=["TRANS_TIMESTAMP"]
    )


@query
def order_page_deep(spark, sf_dir):
    """The fifth page by priority and delay, from a ranking kept."""
    kept = paging.ranked(_board(spark, sf_dir), ["Priority", "Delta Current To Plan", "ordinal"])
    return paging.page_of(kept, [], 5)


@query
def order_page_after(spark, sf_dir):
    """What follows the second page by lot, read on from its last row."""
    order = ["Lot Number", "ordinal"]
    board = _board(spark, sf_dir)
    last = None
    for _ in range(2):
        page = paging.page_after(board, order, last)
        last = page.orderBy(F.col("Lot Number").desc_nulls_first(), F.col("ordinal").desc()).first().asDict()
    return paging.page_after(board, order, last)


@query
def order_page_info(spark, sf_dir):
    return paging.page_info(orders.of_owners(_board(spark, sf_dir)), 2)


@query
def delta_format(spark, sf_dir):
    board = _ingested_board(spark, sf_dir)
    delta = orders.named("Delta Current To Plan")
    return board.select(
        "ordinal",
        display.short_delta(delta).alias("short_text"),
        display.delta_text(delta).alias("delta_text"),
        display.delta_sign(delta).alias("delta_sign"),
    )


# ---- annotations -----------------------------------------------------------------------


@query
def annotations_clean(spark, sf_dir):
    return annotation_records.clean(derive.unrepaired_descriptions(spark, sf_dir))


@query
def annotations_read(spark, sf_dir):
    path = new_path(spark, "records")
    derive.write_records(spark, sf_dir, path)
    return annotation_records.read_records(spark, path)


@query
def annotations_emptied(spark, sf_dir):
    """All saved annotations removed, then new ones added."""
    path = new_path(spark, "annotations")
    annotation_records.save(derive.descriptions(spark, sf_dir), path)
    annotation_records.update(spark, path, lambda saved: saved.where(F.lit(False)))
    entered = derive.entered_descriptions(spark, sf_dir)
    annotation_records.update(spark, path, lambda saved: annotations.append(saved, entered))
    return annotation_records.read_saved(spark, path)


@query
def annotations_two_writers(spark, sf_dir):
    """One writer removes annotations while another adds some; both changes count."""
    path = new_path(spark, "annotations")
    annotation_records.save(derive.descriptions(spark, sf_dir), path)
    entered = annotations.submitted(derive.entered_descriptions(spark, sf_dir))
    late = [entered]

    def remove(saved: DataFrame) -> DataFrame:
        left = annotations.delete(saved, derive.annotation_keys(spark, sf_dir))
        if late:  # the other writer is faster
            annotation_records.add(late.pop().withColumn("OPERATION", F.lit("0")), path)
        return left

    annotation_records.update(spark, path, remove)
    return annotation_records.read_saved(spark, path)


@query
def annotation_categories(spark, sf_dir):
    return annotations.categories(derive.descriptions(spark, sf_dir))


@query
def annotations_by_category(spark, sf_dir):
    return annotations.by_category(annotation_records.clean(derive.descriptions(spark, sf_dir)))


@query
def annotations_of_category(spark, sf_dir):
    return annotations.of_category(annotation_records.clean(derive.descriptions(spark, sf_dir)), "Uncategorized")


@query
def annotations_append(spark, sf_dir):
    existing = annotation_records.clean(derive.descriptions(spark, sf_dir))
    return annotations.append(existing, derive.entered_descriptions(spark, sf_dir))


@query
def annotations_lookup(spark, sf_dir):
    existing = annotation_records.clean(derive.descriptions(spark, sf_dir))
    return annotations.lookup(existing, derive.annotation_keys(spark, sf_dir))


@query
def annotations_delete(spark, sf_dir):
    existing = annotation_records.clean(derive.descriptions(spark, sf_dir))
    return annotations.delete(existing, derive.annotation_keys(spark, sf_dir))


# ---- lot lists, workbooks, quality, sinks --------------------------------------------------


@query
def lots_from_text(spark, sf_dir):
    return workbook.lots_from_text(derive.lot_requests(spark, sf_dir), "lots")


@query
def workbook_merge(spark, sf_dir):
    return _book(spark, sf_dir, sheets.read_sheets)


@query
def workbook_read(spark, sf_dir):
    return _book(spark, sf_dir, lambda s, root: sheets.read_sheet(s, root, ""))


@query
def workbook_read_wide(spark, sf_dir):
    """A sheet whose columns differ from lot to lot."""
    return _book(spark, sf_dir, lambda s, root: sheets.read_sheet(s, root, derive.LONG_SHEET))


@query
def workbook_catalogue(spark, sf_dir):
    return _book(spark, sf_dir, sheets.catalogue)


@query
def workbook_unreadable(spark, sf_dir):
    return _book(spark, sf_dir, sheets.unreadable).select("record")


def _book(spark, sf_dir, read) -> DataFrame:
    root = new_path(spark, "workbook")
    derive.write_sheets(spark, sf_dir, root)
    return read(spark, root)


@query
def table_profile(spark, sf_dir):
    return quality.table_profile(read_table(spark, sf_dir, "orders"), distinct=False)


@query
def table_profile_distinct(spark, sf_dir):
    """Whether the approximate counts are within 15 % of the exact ones."""
    table = read_table(spark, sf_dir, "orders")
    exact = table.agg(F.array(*[F.count_distinct(c) for c in table.columns])).scalar()
    near = F.abs(F.col("approx_distinct") - exact[F.col("ordinal") - 1]) <= exact[F.col("ordinal") - 1] * 0.15 + 1
    return quality.table_profile(table).select("ordinal", "column_name", near.alias("near_exact"))


@query
def table_fingerprint(spark, sf_dir):
    return quality.table_fingerprint(read_table(spark, sf_dir, "customer"))


@query
def table_profile_kept(spark, sf_dir):
    """A table that got another half, profiled file by file; estimates as whether they are near."""
    path, root = new_path(spark, "orders"), new_path(spark, "profile")
    rows = read_table(spark, sf_dir, "orders")
    for half in (F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1):
        rows.where(half).write.mode("append").parquet(path)
        table = spark.read.parquet(path)
        profiles.add_files(table, root)
    exact = rows.agg(F.array(*[F.count_distinct(c) for c in rows.columns])).scalar()
    median = rows.agg(
        F.array(*[F.percentile(c, 0.5) if c in ("o_orderkey", "o_custkey", "o_totalprice") else F.lit(None) for c in rows.columns])
    ).scalar()
    at = F.col("ordinal") - 1
    near = F.abs(F.col("approx_distinct") - exact[at]) <= exact[at] * 0.08 + 1
    middle = F.abs(F.col("quantiles")[1] - median[at]) <= F.abs(median[at]) * 0.15 + 1
    kept = profiles.profile(table, root)
    return kept.select(
        "ordinal", "column_name", "data_type", "row_count", "null_count", "min_value", "max_value",
        near.alias("near_exact"), F.coalesce(middle, F.lit(True)).alias("near_median"),
    )


@query
def changed_customers(spark, sf_dir):
    """Customers that differ from an earlier state, found by their fingerprints' trees."""
    now = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    earlier = now.where(key % 83 != 5).withColumn(
        "c_acctbal", F.when(key % 89 == 7, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    )
    gone = now.where(key % 97 == 3).withColumn("c_custkey", key + 10_000_000)
    earlier = earlier.unionByName(gone)
    stored_trees = []
    for state in (earlier, now):
        path = new_path(spark, "tree")
        trees.tree(state, "c_custkey", width=8).write.parquet(path)
        stored_trees.append(spark.read.parquet(path))
    return trees.changed_keys(earlier, now, "c_custkey", *stored_trees, width=8)


@query
def row_fingerprints(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer")
    return customer.select("c_custkey", quality.row_fingerprint(customer).alias("fingerprint"))


@query
def log_triage(spark, sf_dir):
    return quality.triage_counts(derive.run_logs(spark, sf_dir))


@query
def csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "csv")
    board = orders.board(derive.priority_orders(spark, sf_dir))
    files.write_csv(board, path)
    return files.read_csv(spark, path, board.schema)


@query
def csv_roundtrip_in_lines(spark, sf_dir):
    """No cell of these orders holds a line feed, so files may be split."""
    path = new_path(spark, "csv")
    board = orders.board(derive.priority_orders(spark, sf_dir), keep=["ordinal"])
    files.write_csv(board, path)
    return files.read_csv(spark, path, board.schema, line_feeds_in_cells=False)


@query
def json_roundtrip(spark, sf_dir):
    path = new_path(spark, "annotations")
    annotation_records.save(derive.descriptions(spark, sf_dir), path)
    return annotation_records.read_saved(spark, path)


