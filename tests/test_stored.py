import dataclasses
import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fabtrace.plans import monitor, stored
from fabtrace.sources import commits
from tests import helpers
from tests.helpers import at, rows_of

AS_OF = at(100)


def moves(lot, *hours, **extra):
    steps = ["10", "20", "30", "40"]
    return [
        {"lot": lot, "operation": steps[i % 4], "to_operation": steps[(i + 1) % 4], "time_stamp": at(h),
         "enter_operation_time_stamp": at(h - 1), "due_cycle_time": 0.25} | extra
        for i, h in enumerate(hours)
    ]


def tables(spark, rows, **route_extra):
    ro = helpers.route(spark, {"10": 10, "20": 20, "30": 30, "40": 40}, **route_extra)
    return helpers.tables(spark, helpers.transactions(spark, rows), ro)


ROWS = moves("A", 1, 2, 3, 4) + moves("B", 1, 5, 6) + moves("C", 2, 3) + moves(None, 1)


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def agrees(spark, root, t, as_of=AS_OF):
    full = monitor.lot_monitor(t, as_of, keep_order=True)
    assert stored.read(spark, root).columns == full.columns
    assert rows_of(stored.read(spark, root)) == rows_of(full)


def parts(spark, root):
    now = commits.current(commits.entries(spark, root))
    rows = spark.read.parquet(*[f"{root}/{e.part}/marks" for e in now])
    return [sorted(r.lot for r in rows.where(F.col("_part") == e.part).collect()) for e in now]


def test_only_changed_lots_are_computed(spark, tmp_path):
    root = str(tmp_path / "kept")
    with pytest.raises(ValueError):
        stored.read(spark, root)
    assert stored.refresh(tables(spark, ROWS), AS_OF, root) == 1
    before = files(root)

    assert stored.refresh(tables(spark, ROWS[::-1]), AS_OF, root) == 1  # row order is no change
    more = ROWS + moves("B", 9) + moves("D", 7, 8)
    assert stored.refresh(tables(spark, more), AS_OF, root) == 2
    agrees(spark, root, tables(spark, more))
    assert parts(spark, root)[-1] == ["B", "D"]
    assert {p: t for p, t in files(root).items() if p in before} == before

    late = more + moves("C", 1)  # a row earlier than all of its lot
    corrected = [r | {"deleted_flag": "Y"} if r["lot"] == "A" and r["time_stamp"] == at(2) else r for r in late]
    gone = [r for r in corrected if r["lot"] != "D"]
    assert stored.refresh(tables(spark, gone), AS_OF, root) == 3
    assert parts(spark, root)[-1] == ["A", "C", "D"]
    agrees(spark, root, tables(spark, gone))
    kept = rows_of(stored.read(spark, root))
    assert stored.compact(spark, root) == 4
    assert rows_of(stored.read(spark, root)) == kept
    assert stored.compact(spark, root) == 4
    assert stored.refresh(tables(spark, more), AS_OF, root) == 5  # and back
    agrees(spark, root, tables(spark, more))


def test_another_day_and_another_plan(spark, tmp_path):
    root = str(tmp_path / "kept")
    t = tables(spark, ROWS + moves("L", 3, 40, 60))
    assert stored.refresh(t, at(20), root) == 1
    assert stored.refresh(t, at(50), root) == 2
    assert parts(spark, root)[-1] == ["L"]  # nothing of the others is later than the first day
    assert stored.refresh(t, at(30), root) == 3
    agrees(spark, root, t, at(30))
    changed = tables(spark, ROWS, **{"20": {"process_cycle_time": 2.0}})
    assert stored.refresh(dataclasses.replace(changed, transactions=t.transactions), at(30), root) == 4
    assert parts(spark, root) == [["A", "B", "C", "L"]]


def test_refreshes_at_once(spark, tmp_path):
    root = str(tmp_path / "kept")
    stored.refresh(tables(spark, ROWS), AS_OF, root)
    more = tables(spark, ROWS + moves("A", 9))
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda _: stored.refresh(more, AS_OF, root), range(2))) == [2, 2]
    agrees(spark, root, more)


def test_no_lots(spark, tmp_path):
    root = str(tmp_path / "kept")
    stored.refresh(tables(spark, []), dt.datetime(2024, 1, 1), root)
    assert stored.read(spark, root).count() == 0
