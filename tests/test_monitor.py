import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from checks import derive
from fabtrace.operators import holds, moves, route
from fabtrace.plans import monitor
from tests.helpers import at, route as planned, rows_of, tables, transactions

AS_OF = dt.datetime(2024, 2, 1)


def move(lot, hours, operation, to_operation, **more):
    return {"lot": lot, "time_stamp": at(hours), "operation": operation, "to_operation": to_operation} | more


@pytest.fixture(scope="module")
def small_tables(spark, small):
    return derive.lot_tables(spark, small)


@pytest.fixture(scope="module")
def small_monitor(small_tables):
    return monitor.lot_monitor(small_tables, derive.AS_OF, keep_order=True)


def test_known_counts(small_tables, small_monitor):
    t = small_tables
    boundaries = route.boundary_moves(t.transactions, t.route_operations)
    assert boundaries.count() == 595
    assert boundaries.where("operation IS NOT NULL").count() == 239
    segments = route.route_segments(boundaries, derive.AS_OF)
    assert segments.count() == 93
    assert route.route_master(segments, t.route_operations, t.operations).count() == 350
    assert holds.hold_history(t.transactions, t.parameters).count() == 186
    assert moves.timed_moves(t.transactions).count() == 567
    visited = monitor.visits(t, derive.AS_OF)
    counts = visited.agg(
        F.count("*"),
        F.count_if(F.col("ACTUAL_CT").isNull()),
        F.count("HOLD_TIME_HRS"),
        F.count("RPT"),
        F.count_if(F.col("OPERATION_DESC") == "??"),
    )
    assert tuple(counts.first()) == (527, 137, 32, 390, 93)
    assert small_monitor.count() == 428
    summary = monitor.delay_summary(small_monitor)
    assert summary.count() == 84
    shown = rows_of(summary.where("LOT = 'VA000000'"), "OPERATION", "SUM_DELAY", "COUNT")
    assert {("1065", -2.1227, 4), ("1102", -1.0262, 2)} <= set(shown)


def test_rows_without_lot_or_time(spark, small_tables, small_monitor):
    """Rows without a lot change nothing; one without a time stays last in its lot."""
    tx = small_tables.transactions
    strays = tx.limit(50).withColumn("lot", F.lit(None).cast("string"))
    with_strays = monitor.replace(small_tables, transactions=tx.unionByName(strays))
    assert rows_of(monitor.lot_monitor(with_strays, derive.AS_OF, keep_order=True)) == rows_of(small_monitor)
    rows = [move("L", 0, "A", "B"), move("L", 1, "B", "C"), move("L", 2, "C", "D")]
    ro = planned(spark, {"A": 10, "B": 20, "C": 30})
    made = transactions(spark, rows)
    timeless = made.where("operation = 'C'").withColumn("time_stamp", F.lit(None).cast("timestamp_ntz"))
    t = tables(spark, made.where("operation != 'C'").unionByName(timeless), ro)
    timed = moves.timed_moves(t.transactions)
    assert [r["operation"] for r in timed.orderBy(F.col("trans_time").asc_nulls_last()).collect()] == ["A", "B", "C"]
    assert rows_of(timed.where("operation = 'C'"), "trans_time", "cycle_time") == {(None, 0.0): 1}
    held = holds.with_hold_time(timed, holds.hold_history(t.transactions, t.parameters))
    assert held.where("operation = 'C' AND actual_holdtime IS NOT NULL").count() == 0


def test_the_segment_before_one_without_a_time_has_no_end(spark):
    ro = planned(spark, {"A": 10, "B": 20})
    tx = transactions(spark, [move("L", 0, "A", "B"), move("L", 1, "A", "B", route="S")])
    late = tx.where("route = 'S'").withColumn("time_stamp", F.lit(None).cast("timestamp_ntz"))
    bounds = route.boundary_moves(tx.where("route = 'R'").unionByName(late), ro)
    got = rows_of(route.route_segments(bounds, AS_OF), "route", "route_leave_time_stamp")
    assert got == {("R", None): 1, ("S", AS_OF + dt.timedelta(hours=1)): 1}


def test_segments_do_not_overlap(small_tables):
    t = small_tables
    segments = route.route_segments(route.boundary_moves(t.transactions, t.route_operations), derive.AS_OF)
    spans = {}
    for r in segments.collect():
        spans.setdefault(r["lot"], []).append((r["route_order_seq"], r["route_leave_time_stamp"]))
    for lot in spans.values():
        lot.sort()
        assert all(a[1] == b[0] for a, b in zip(lot, lot[1:]))
        assert lot[-1][1] == derive.AS_OF + dt.timedelta(hours=1)


def test_null_target_operation_is_no_move(spark):
    tx = transactions(spark, [move("L", 0, "A", "B"), move("L", 1, "B", None), move("L", 2, "B", "B")])
    assert moves.timed_moves(tx).count() == 1


def test_null_deleted_flag_is_dropped_from_moves_but_not_from_the_route(spark):
    tx = transactions(spark, [move("L", 0, "A", "B", deleted_flag=None)])
    assert moves.timed_moves(tx).count() == 0
    assert route.boundary_moves(tx, planned(spark, {"A": 10})).count() == 1


def test_times_count_from_the_previous_move(spark):
    tx = transactions(
        spark,
        [
            move("L", 6, "A", "B", enter_operation_time_stamp=at(0), movein_time_stamp=at(3)),
            move("L", 30, "B", "C", enter_operation_time_stamp=at(1), movein_time_stamp=None),
            move("M", 30, "B", "C"),
        ],
    )
    got = rows_of(moves.timed_moves(tx), "lot", "operation", "cycle_time", "wt")
    assert got == {("L", "A", 0.25, 0.125): 1, ("L", "B", 1.0, 0.0): 1, ("M", "B", 0.0, 0.0): 1}


def test_loop_back_has_no_target(spark):
    ro = planned(spark, {"A": 10, "B": 20, "C": 30})
    tx = transactions(
        spark,
        [move("L", 0, "A", "B"), move("L", 1, "B", "C"), move("L", 2, "A", "B"), move("L", 3, "C", "D")],
    )
    segments = route.route_segments(route.boundary_moves(tx, ro), AS_OF)
    # Back to the first step: a second segment starts there.
    assert rows_of(segments, "route_order_seq", "operation_sequence_number", "loop_back_indicator") == {
        (at(0), 10, 10): 1,
        (at(2), 10, 20): 1,
    }
    t = tables(spark, tx, ro)
    master = route.route_master(segments, ro, t.operations)
    second = rows_of(master.where(F.col("route_order_seq") == F.lit(at(2))), "operation", "due_ct")
    assert second == {("A", None): 1, ("B", 0.75): 1, ("C", 0.75): 1}


def test_next_step_default_and_null(spark):
    # Z is not on the route: its step is null, so A is "visited until" its own step.
    ro = planned(spark, {"A": 10, "B": 20})
    tx = transactions(spark, [move("L", 0, "A", "Z"), move("L", 1, "Z", "B")])
    bounds = route.boundary_moves(tx, ro)
    segments = route.route_segments(bounds, AS_OF)
    first = segments.where("operation = 'A'").first()
    assert first["to_operation_sequence_number"] is None or first["to_operation_sequence_number"] >= 10
    only = route.route_segments(route.boundary_moves(tx.where("operation = 'A'"), ro), AS_OF).first()
    assert (only["to_operation_sequence_number"], only["visited_until"]) == (99999, 99999)


def test_zero_target_gives_ratio_one(spark):
    ro = planned(spark, {"A": 10, "B": 20})
    tx = transactions(
        spark,
        [
            move("L", 24, "A", "B", due_cycle_time=0.0, enter_operation_time_stamp=at(0)),
            move("L", 48, "B", "C", due_cycle_time=0.5, enter_operation_time_stamp=at(24)),
        ],
    )
    got = rows_of(monitor.lot_monitor(tables(spark, tx, ro), AS_OF), "OPERATION", "FF_TO_TARGET", "DELAY")
    assert got == {("A", 1.0, -1.0): 1, ("B", 2.0, -0.5): 1}


def test_covered_rows_are_dropped_per_lot(spark):
    ro = planned(spark, {"A": 10, "B": 20, "C": 30})
    steps = [("A", "B"), ("B", "C"), ("C", "A"), ("A", "B")]
    tx = transactions(
        spark, [move("L", h, *step) for h, step in enumerate(steps)] + [move("M", 0, "A", "B")]
    )
    got = rows_of(monitor.lot_monitor(tables(spark, tx, ro), AS_OF), "LOT", "OPERATION", "TRANS_TIME")
    # The first segment of L covers A and B, the second one all steps.  Its empty B is dropped
    # as L was at B before; M keeps its empty B and C.
    assert got == {
        ("L", "A", at(0)): 1,
        ("L", "B", at(1)): 1,
        ("L", "A", at(3)): 1,
        ("L", "C", None): 1,
        ("M", "A", at(0)): 1,
        ("M", "B", None): 1,
        ("M", "C", None): 1,
    }


def test_store_flag_compares_text(spark):
    rows = [move("L", 0, "916", "917"), move("M", 0, "1000", "1001"), move("N", 0, "0999", "1")]
    t = tables(spark, transactions(spark, [r | {"route": None} for r in rows]), planned(spark, {}))
    got = rows_of(monitor.lot_monitor(t, AS_OF), "OPERATION", "STORE_FLAG")
    assert got == {("916", "N"): 1, ("1000", "N"): 1, ("0999", "Y"): 1}


def test_hold_history(spark):
    def event(hours, code):
        return move("L", hours, "A", "B", transcode=code)

    tx = transactions(spark, [event(0, "RLLT"), event(6, "HLLT"), event(18, "RLLT"), event(24, "RLLT")])
    t = tables(spark, tx, planned(spark, {}))
    got = rows_of(holds.hold_history(tx, t.parameters), "rllt_time_stamp", "actual_holdtime")
    # The first event has none; two releases in a row give the gap between them.
    assert got == {(at(0), None): 1, (at(18), 0.5): 1, (at(24), 0.25): 1}


def test_hold_time_equals_pairing_every_release(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        start = rng.randrange(500)
        rows.append(
            move(
                rng.choice(["L", "M"]),
                start + i / 1000,
                rng.choice(["A", "B"]),
                rng.choice(["A", "B", "C"]),
                transcode=rng.choice(["HLLT", "RLLT", "MVOU"]),
                route=rng.choice(["R", "R", None]),
                enter_operation_time_stamp=rng.choice([None, at(start - rng.randrange(60)), at(start + 5)]),
            )
        )
    tx = transactions(spark, rows)
    params = tables(spark, tx, planned(spark, {})).parameters
    timed = moves.timed_moves(tx)
    releases = holds.hold_history(tx, params)
    got = rows_of(
        holds.with_hold_time(timed, releases).select(
            "lot", "operation", "trans_time", F.round("actual_holdtime", 9).alias("h")
        )
    )
    released = releases.collect()
    expected = {}
    for m in timed.collect():
        held = [
            r["actual_holdtime"]
            for r in released
            if None not in (m["route"], m["enter_op_ts"], r["actual_holdtime"])
            and all(m[k] == r[k] for k in holds.PLACE)
            and m["enter_op_ts"] <= r["rllt_time_stamp"] <= m["trans_time"]
        ]
        key = (m["lot"], m["operation"], m["trans_time"], round(sum(held), 9) if held else None)
        expected[key] = expected.get(key, 0) + 1
    assert any(k[3] for k in expected)
    assert got == expected


def test_lot_list_limits_the_monitor(spark, small_tables, small_monitor):
    lots = spark.createDataFrame([("VA000001",), ("VA000003",), ("none",)], "lot string")
    some = monitor.lot_monitor(small_tables.of_lots(lots), derive.AS_OF, keep_order=True)
    assert rows_of(some) == rows_of(small_monitor.where("LOT IN ('VA000001', 'VA000003')"))
    one = monitor.lot_monitor(small_tables.of_lot("VA000003"), derive.AS_OF, keep_order=True)
    assert rows_of(one) == rows_of(small_monitor.where("LOT = 'VA000003'"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan(spark, tmp_path, small_tables):
    # On stored tables: the lot filter reaches the scan, nothing is paired by nested loops, no
    # Python runs, and no more scans of the transactions run than the branches need.
    path = str(tmp_path / "tx")
    small_tables.transactions.write.parquet(path)
    stored = monitor.replace(small_tables, transactions=spark.read.parquet(path))
    plan = plan_of(monitor.lot_monitor(stored.of_lot("VA000001"), derive.AS_OF))
    assert "EqualTo(lot,VA000001)" in plan
    report = monitor.lot_monitor(stored, derive.AS_OF)
    plan = plan_of(report)
    for node in ("NestedLoop", "Cartesian", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan
    report.collect()
    final = plan_of(report).split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line and "deleted_flag" in line or "FileScan parquet [lot" in line]
    assert 0 < len(scans) <= 3, scans
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(r_lot" in line or "Exchange hashpartitioning(l_lot" in line]
    assert len(wide) == 1 and "r_operation" in wide[0]
