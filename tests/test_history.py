from checks import derive
from fabtrace.operators import history
from fabtrace.sources import schemas
from tests.helpers import at, frame, rows_of


def test_first_source_wins(spark):
    mes = frame(
        spark,
        schemas.HISTORY_MES,
        [{"lot_number": "L", "operation": "1", "transaction": "MVIN", "trans_timestamp": at(0), "operator_id": "M"}],
    )
    other = frame(
        spark,
        schemas.HISTORY_FALLBACK,
        [
            {"lot": "L", "operation": "1", "transcode": "MVIN", "time_stamp": at(0), "operator": "A"},
            {"lot": "L", "operation": "1", "transcode": "MVIN", "time_stamp": None, "operator": "B"},
            {"lot": "L", "operation": "1", "transcode": "MVIN", "time_stamp": None, "operator": "B"},
            {"lot": "K", "operation": "1", "transcode": "MVIN", "time_stamp": at(0), "operator": "C"},
        ],
    )
    got = rows_of(history.union_history({"mes": mes, "old": None, "other": other}), "LOT", "OPERATOR_ID")
    assert got == {("L", "M"): 1, ("L", "B"): 1, ("K", "C"): 1}
    assert history.union_history({"mes": None}).count() == 0


def test_text_times_are_parsed(spark):
    rows = [("L", "1", "MVIN", "2024-01-01 01:00:00"), ("L", "1", "MVIN", "not a time")]
    df = spark.createDataFrame(rows, "lot string, operation string, transcode string, time_stamp string")
    for c in ("sps_number", "equipment", "operator", "transaction_comment"):
        df = df.selectExpr("*", f"cast(null as string) as {c}")
    got = rows_of(history.union_history({"x": df}), "TRANS_TIMESTAMP")
    assert got == {(at(1),): 1, (None,): 1}


def test_unified_counts_and_keys(spark, small):
    sources = derive.history_sources(spark, small)
    assert sum(s.count() for s in sources.values()) == 2034
    merged = history.union_history(sources)
    assert merged.count() == 1000
    keys = merged.groupBy("LOT", "TRANS_TIMESTAMP", "OPERATION", "TRANSACTION").count()
    assert keys.where("count > 1").count() == 0
    order = [r["TRANS_TIMESTAMP"] for r in history.in_time_order(merged.where("LOT = 'VA000001'")).collect()]
    assert order == sorted(order, reverse=True)


def test_copies_are_dropped_before_the_shuffle(spark, small):
    merged = history.union_history(derive.history_sources(spark, small))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_operations_to_show(spark):
    summary = spark.createDataFrame([("L", "1"), ("L", "2")], "LOT string, OPERATION string")
    opened = spark.createDataFrame([("L", "9"), ("M", "8")], "LOT string, OPERATION string")
    assert rows_of(history.operations_to_show(summary, opened)) == {("L", "1"): 1, ("L", "2"): 1, ("M", "8"): 1}
    assert history.of_operation(summary, []).count() == 0
