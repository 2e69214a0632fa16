"""Lot-tracking tables derived from the driver's tables.

The mapping gives every lot table a deterministic content that both Spark and a SQL engine
can compute, so results can be compared.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabtrace.plans.monitor import LotTables
from fabtrace.sources.scratch import new_path
from fabtrace.sources.tables import read_table
from fabtrace.sources.workbook import write_sheet

AS_OF = dt.datetime(2024, 2, 1)

TRANSCODES = {"error": "HLLT", "signup": "RLLT", "purchase": "MVOU", "click": "MVIN", "view": "COMM"}


def operation_of(n: Column) -> Column:
    return (F.lit(880) + n * 37).cast("string")


def lot_of(n: Column) -> Column:
    return F.concat(F.lit("VA"), F.lpad(n.cast("string"), 6, "0"))


def whole(c: Column) -> Column:
    return F.floor(c).cast("int")


def stepped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number within the user, their step and the time three events back."""
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back = events.withColumns({"rn": F.row_number().over(w), "ts_back": F.lag("ts", 3).over(w)})
    step0 = whole((F.col("rn") - 1) / 4.0) % 12 + 1
    step = F.when((F.col("event_id") % 9 == 0) & (F.col("_step0") > 3), F.col("_step0") - 3)
    return (
        back.withColumn("_step0", step0)
        .withColumn("step", step.otherwise(F.col("_step0")))
        .select("event_id", "ts", "user_id", "event_type", "rn", "step", "ts_back")
    )


# Parts that make up one group of two facilities with three routes of twelve steps.
GROUP = 72


def part_groups(spark: SparkSession, sf_dir: str) -> Column:
    """How many such groups the parts make."""
    part = read_table(spark, sf_dir, "part")
    return part.agg((whole(F.max("p_partkey") / float(GROUP)) + 1).alias("groups")).scalar()


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ts = F.col("ts")
    s = lambda c: c.cast("string")
    # A lot stays in one group of the parts and passes through its routes.
    place = F.col("place")
    route = F.concat(F.lit("R"), s((F.col("user_id") + whole((F.col("rn") - 1) / 48.0)) % 3 + 3 * whole(place / 2.0)))
    code = F.create_map(*[F.lit(x) for kv in TRANSCODES.items() for x in kv])
    yes_no = lambda n: F.when(e % n == 0, "Y").otherwise("N")
    flag = lambda n: F.when(e % n == 0, "Y")
    placed = stepped_events(spark, sf_dir).withColumn(
        "place", F.col("user_id") % (2 * part_groups(spark, sf_dir))
    )
    return placed.select(
        lot_of(F.col("user_id")).alias("lot"),
        F.concat(F.lit("F"), s(place)).alias("facility"),
        F.when(e % 53 != 0, route).alias("route"),
        operation_of(F.col("step")).alias("operation"),
        F.when(e % 97 == 0, None)
        .when(F.col("event_type").isin("error", "signup"), operation_of(F.col("step")))
        .otherwise(operation_of(F.col("step") + 1))
        .alias("to_operation"),
        ts.alias("time_stamp"),
        F.date_trunc("day", ts).cast("timestamp_ntz").alias("date_stamp"),
        F.when(e % 29 == 0, "Y").when(e % 31 == 0, None).otherwise("N").alias("deleted_flag"),
        code[F.col("event_type")].alias("transcode"),
        (e % 25).cast("int").alias("qty_out_1"),
        F.lit("WFR").alias("unit_1"),
        F.when(e % 17 != 0, F.concat(F.lit("EQ"), s(e % 40))).alias("equipment"),
        F.concat(F.lit("W"), s(e % 5)).alias("work_center"),
        F.concat(F.lit("C"), s(e % 4)).alias("cost_center"),
        yes_no(13).alias("rework_flag"),
        flag(10).alias("hot_lot_flag"),
        flag(14).alias("hot_oper_flag"),
        flag(19).alias("super_hot_flag"),
        F.coalesce("ts_back", ts - F.expr("INTERVAL 6 HOURS")).alias("enter_operation_time_stamp"),
        F.when(e % 4 == 0, ts - F.expr("INTERVAL 10 MINUTES"))
        .when(e % 4 == 1, ts - F.expr("INTERVAL 1 HOUR"))
        .when(e % 4 == 2, ts)
        .alias("movein_time_stamp"),
        F.when(e % 5 != 0, (e % 7) * F.lit(0.125)).alias("due_cycle_time"),
        ((e % 3) * F.lit(0.0625)).alias("due_process_cycle_time"),
        F.when(e % 6 != 0, F.concat(F.lit("S"), s(e % 8))).alias("sps_number"),
        F.concat(F.lit("M"), s(e % 3)).alias("main_sps"),
    )


def earlier_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known before: of a third of the lots the last days are missing, of some lots
    rows were deleted meanwhile, and of others a row within came late."""
    n = F.substring("lot", 3, 6).cast("int")
    rows = transactions(spark, sf_dir)
    known = rows.where(
        ~((n % 3 == 0) & (F.col("time_stamp") >= F.expr("timestamp_ntz'2024-01-20'")))
        & ~((n % 7 == 1) & (F.col("qty_out_1") == 3))
    )
    undeleted = F.when((n % 5 == 2) & (F.col("deleted_flag") == "Y"), "N").otherwise(F.col("deleted_flag"))
    return known.withColumn("deleted_flag", undeleted)


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its group ``g`` and its place ``k`` there."""
    key = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        whole(key / float(GROUP)).alias("g"), (key % GROUP).alias("k"), "p_name", "p_type", "p_brand"
    )


def route_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("k"), F.col("g")
    step = whole(k / 6.0) % 12 + 1
    return _slots(spark, sf_dir).select(
        F.concat(F.lit("F"), (k % 2 + 2 * g).cast("string")).alias("facility"),
        F.concat(F.lit("R"), (whole(k / 2.0) % 3 + 3 * g).cast("string")).alias("route"),
        operation_of(step).alias("operation"),
        (step * 10).alias("operation_sequence_number"),
        F.when(k % 5 == 0, F.expr("timestamp_ntz'2024-01-20'"))
        .otherwise(F.expr("timestamp_ntz'2024-12-31'"))
        .alias("create_date"),
        (step * F.lit(0.03125)).alias("process_cycle_time"),
        ((step % 4) * F.lit(0.0625)).alias("queue_cycle_time"),
        F.when(k % 11 == 0, "Y").when(k % 7 == 0, None).otherwise("N").alias("optional_oper_flag"),
    )


def versioned_route_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one or two earlier versions of most, which were slower and a step later."""
    planned = route_operations(spark, sf_dir)
    step = F.col("operation_sequence_number") / F.lit(10)
    age = F.explode(F.array(*[F.lit(a) for a in range(3)])).alias("age")
    every = planned.select("*", age).where((F.col("age") == 0) | (step % (F.col("age") + 1) != 0))
    earlier = F.when(F.col("age") == 0, F.col("create_date")).otherwise(
        F.expr("timestamp_ntz'2024-01-20' - make_dt_interval(4 * age)")
    )
    slower = F.col("process_cycle_time") * (F.col("age") + 1)
    later = (F.col("operation_sequence_number") + F.col("age")).cast("int")
    changed = every.withColumns(
        {"create_date": earlier, "process_cycle_time": slower, "operation_sequence_number": later}
    )
    return changed.drop("age")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as operations; step 12 of the routes has none."""
    k, g = F.col("k"), F.col("g")
    step = whole(k / 2.0) + 1
    return _slots(spark, sf_dir).select(
        F.concat(F.lit("F"), (k % 2 + 2 * g).cast("string")).alias("facility"),
        operation_of(F.when(step > 11, step + 1).otherwise(step)).alias("operation"),
        F.when(k % 3 != 0, F.concat("p_type", F.lit(" "), "p_brand")).alias("operation_long_desc"),
        F.when(k % 9 != 0, F.col("p_name")).alias("operation_short_desc"),
        F.when(k % 8 == 0, None).when(k % 4 == 1, "Y").otherwise("N").alias("store_flag_rep"),
    )


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("EQ"), F.col("s_suppkey").cast("string")).alias("equipment"),
        F.col("s_name").alias("equipment_desc"),
    )


def parameters(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES ('HOLD START TRANSACTION', 'HLLT'),"
        " ('HOLD RELEASE TRANSACTION', 'RLLT') AS t(var_name, var_value)"
    )


def lot_tables(spark: SparkSession, sf_dir: str) -> LotTables:
    return LotTables(
        transactions(spark, sf_dir),
        route_operations(spark, sf_dir),
        operations(spark, sf_dir),
        equipment(spark, sf_dir),
        parameters(spark),
    )


# ---- histories -------------------------------------------------------------------------

MES_CODES = [
    "2RSV", "2SON", "2SIN", "2PSO", "2PSI", "MVIN", "MVOU", "TRST", "SLTA", "COMM", "RLLT", "HLLT",
    "1RCL", "ALFG", "2SHL", "2HLD", "2HRL", "EI", "EDC", "JC", "TASK", "2CRT", "2SCR", "UNKN",
]
FALLBACK_CODES = [
    "MVOU", "MVIN", "RLLT", "HLLT", "1RCL", "TRST", "SLTA", "COMM", "JC", "EDC", "TASK", "2HLD",
    "2HRL", "UNKN",
]


def _pick(n: Column, values: list) -> Column:
    """The n-th of the values, counted from 0."""
    return F.get(F.array(*[F.lit(v).cast("string") if not isinstance(v, Column) else v for v in values]), n.cast("int"))


QUANTITIES = [
    "025", "25.50", "abc", None, "0.50", "100", "123456789012345678901234567890123456789012.00000000000120",
    "-0.000000000000001", "1.5e3",
]


def recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the texts a history keeps of them."""
    e = F.col("event_id")
    events = stepped_events(spark, sf_dir)
    code = F.create_map(*[F.lit(x) for kv in TRANSCODES.items() for x in kv])
    s = lambda c: c.cast("string")
    note = F.concat(F.lit(" note;of "), s(e), F.lit(" "))
    return events.select(
        "event_id",
        lot_of(F.col("user_id")).alias("lot"),
        operation_of(F.col("step")).alias("operation"),
        code[F.col("event_type")].alias("transcode"),
        F.col("ts").alias("time_stamp"),
        F.when(e % 6 != 0, F.concat(F.lit("S"), s(e % 8))).alias("sps_number"),
        F.when(e % 17 != 0, F.concat(F.lit("EQ"), s(e % 40))).alias("equipment"),
        F.when(e % 7 != 0, F.concat(F.lit("OP"), s(e % 10))).alias("operator"),
        _pick(e % 5, [None, "", "   ", "a;b", note]).alias("comment"),
        F.when(e % 2 == 0, "Y").otherwise("N").alias("is_reserved"),
        F.when(e % 3 != 0, F.concat(F.lit("RM"), s(e % 9))).alias("is_reserved_machine"),
        F.when(e % 4 != 0, F.concat(F.lit("RO"), s(e % 11))).alias("is_reserved_operator"),
        _pick(F.floor(e / 24) % 9, QUANTITIES).alias("quantity_1"),
        F.when(e % 3 != 1, F.concat(F.lit("H"), s(e % 6))).alias("hold_code"),
        _pick(F.floor(e / 24) % 4, [None, "  ", "held", F.repeat(note, 60)]).alias("hold_comment"),
    )


def history_mes(recorded: DataFrame) -> DataFrame:
    return recorded.select(
        F.col("lot").alias("lot_number"),
        "operation",
        F.col("transcode").alias("transaction"),
        F.col("time_stamp").alias("trans_timestamp"),
        F.col("sps_number").alias("current_sip"),
        F.col("equipment").alias("actual_entity"),
        F.col("operator").alias("operator_id"),
        F.col("comment").alias("commenttext"),
        "is_reserved",
        "is_reserved_machine",
        "is_reserved_operator",
        "quantity_1",
        "hold_code",
        "hold_comment",
    )


def history_fallback(recorded: DataFrame) -> DataFrame:
    return recorded.select(
        "lot",
        "operation",
        "transcode",
        "time_stamp",
        "sps_number",
        "equipment",
        "operator",
        F.col("comment").alias("transaction_comment"),
    )


def history_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Four histories that overlap: three kept the events their number divides, the last all."""
    recorded = recorded_events(spark, sf_dir)
    kept = lambda n: recorded.where(F.col("event_id") % n == 0)
    return {
        "mes": history_mes(kept(2)),
        "fallback_1": history_fallback(kept(3)),
        "fallback_2": history_fallback(kept(5)),
        "fallback_3": history_fallback(recorded),
    }


# ---- orders ----------------------------------------------------------------------------

OWNERS = ["DEVT", "PROD", "QUAL", None]
STATUSES = ["In Production", "Confirmed", "Done", "Warning", "Terminated", "Parked"]
PRIORITIES = ["Hot", "Rocket", "Normal", "Low"]


def priority_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order attributes, with ``ordinal`` as arrival order."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    code = lambda prefix, n: F.concat(F.lit(prefix), s(k % n))
    day = s(F.col("o_orderdate").cast("date"))
    return read_table(spark, sf_dir, "orders").select(
        k.alias("ordinal"),
        F.concat(F.lit("EO"), s(k)).alias("febesOrderId"),
        _pick(F.col("o_custkey") % 4, OWNERS).alias("owner"),
        _pick(k % 6, STATUSES).alias("orderStatus"),
        s(k % 25).alias("orderQuantity"),
        F.lit("WFR").alias("orderUnit"),
        _pick(k % 3, [None, "", code("rem ", 9)]).alias("orderRemark"),
        _pick(k % 2, ["200", "300"]).alias("waferSize"),
        F.when(k % 7 != 0, lot_of(F.col("o_custkey"))).alias("lotNumber"),
        code("R", 11).alias("lotResponsible"),
        F.when(k % 13 != 0, (k % 401 - 200) * F.lit(0.03125)).alias("deltaCurrentToPlan"),
        code("Q", 13).alias("requestor"),
        code("U", 3).alias("lotPurpose"),
        _pick(k % 4, PRIORITIES).alias("priority"),
        code("C", 5).alias("priorityCorridor"),
        code("F", 2).alias("currentFacility"),
        operation_of(k % 12 + 1).alias("currentOperation"),
        day.alias("confirmedDeliveryDate"),
        F.when(k % 10 != 0, day).alias("currentDeliveryDate"),
        code("D", 5).alias("businessDivision"),
        code("P", 8).alias("processGroup"),
        F.col("o_orderpriority").alias("createUser"),
    )


_LANDED: dict[tuple[str, str], str] = {}


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed payloads, which an application writes once for all queries that read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        path = new_path(spark, "payloads")
        _made_payloads(spark, sf_dir).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def _made_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and its second lot in each payload, with other shapes in between.

    Most give the delay as a number, some as a number in quotes or as text.
    """
    orders = priority_orders(spark, sf_dir)
    k, delta = F.col("ordinal"), F.col("deltaCurrentToPlan")
    text = F.when(k % 17 == 3, "n/a").otherwise(delta.cast("string"))
    return orders.select(
        k.alias("payload_id"),
        F.when(k % 50 == 7, '{"message":"expired","code":401}')
        .when(k % 50 == 8, "[1,2]")
        .when(k % 50 == 9, '{"priorityOrders":{"owner":"DEVT"}}')
        .when(k % 50 == 10, '{"priorityOrders":null,"owner":"DEVT"}')
        .when(k % 50 == 11, '{"priorityOrders":[{"owner":"DEVT"}')
        .when((k % 17).isin(3, 4), _payload(orders, text))
        .otherwise(_payload(orders, delta))
        .alias("value"),
    )


def _payload(orders: DataFrame, delta: Column) -> Column:
    """An order with the given delay, and a second lot of its owner."""
    names = [c for c in orders.columns if c != "ordinal"]
    first = [delta.alias(c) if c == "deltaCurrentToPlan" else F.col(c) for c in names]
    second = [F.concat("febesOrderId", F.lit("B")).alias("febesOrderId"), F.col("owner"), F.col("lotNumber")]
    both = F.concat_ws(",", F.to_json(F.struct(*first)), F.to_json(F.struct(*second)))
    return F.concat(F.lit('{"priorityOrders":['), both, F.lit("]}"))


# ---- annotations, requests, sheets, logs -------------------------------------------------


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(
        lot_of(d % 150).alias("LOT NUMBER"),
        operation_of(d % 12 + 1).alias("OPERATION"),
        F.col("text").alias("DESCRIPTION"),
        _pick(d % 4, ["Disposition", "Delay load", "", None]).alias("ISSUE"),
        F.col("lang").alias("REMARKS"),
    )


def unrepaired_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as found on disk: a column missing, unknown values spelled out."""
    return read_table(spark, sf_dir, "documents").select(*_unrepaired(F.col("doc_id")))


def _unrepaired(d: Column) -> list[Column]:
    return [
        (d % 12 + 1).alias("OPERATION"),
        F.col("text").alias("DESCRIPTION"),
        _pick(d % 4, ["nan", "None", "Batching", None]).alias("ISSUE"),
        lot_of(d % 150).alias("LOT NUMBER"),
    ]


def entered_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "labels").select(
        lot_of(d % 150).alias("LOT NUMBER"),
        operation_of(d % 12 + 1).alias("OPERATION"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("DESCRIPTION"),
        F.when(F.col("toxic") == 1, "—").otherwise("Batching").alias("ISSUE"),
        F.lit("—").alias("REMARKS"),
    )


def annotation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return (
        read_table(spark, sf_dir, "labels")
        .select(lot_of(d % 150).alias("lot"), operation_of(d % 12 + 1).alias("op"))
        .distinct()
    )


def lot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        c.alias("request_id"),
        F.concat(lot_of(c * 2), F.lit(", ,"), lot_of(c * 3), F.lit(" ,")).alias("lots"),
    )


LONG_SHEET = "a sheet name that is longer than a workbook allows"


def write_sheets(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Sheets of two lots' workbooks; their columns and the type of the key differ."""
    customer = read_table(spark, sf_dir, "customer")
    supplier = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation")
    write_sheet(
        customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment"),
        root, "VA000001", LONG_SHEET,
    )
    key = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    write_sheet(
        supplier.select(key.alias("key"), F.col("s_name").alias("name"), "s_nationkey"), root, "VA000002", LONG_SHEET
    )
    write_sheet(nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), root, "VA000002", "")
    damaged = nation.select(F.concat(F.lit("{damaged "), "n_name").alias("value"))
    damaged.write.text(f"{root}/of_lot=VA000003/of_sheet=Sheet1")


def write_records(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Annotations as files of one JSON array each, of 200 documents."""
    d = F.col("doc_id")
    array = F.to_json(F.collect_list(F.struct(*_unrepaired(d)))).alias("value")
    arrays = read_table(spark, sf_dir, "documents").groupBy(whole(d / 200.0)).agg(array)
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


LOG_MARKS = [
    "",
    "IllegalOptionException",
    "customization-profiles",
    "another process has locked a portion of the file",
    "ConfigurationAreaChecker",
    "EXCEPTION_ACCESS_VIOLATION",
    "DB Connection no longer available",
    "created an empty data table",
    "ConfigurationAreaChecker after EXCEPTION_ACCESS_VIOLATION",
]


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(
        d.alias("run_id"),
        lot_of(d % 150).alias("lot"),
        F.concat("text", F.lit("\n"), _pick(d % 9, LOG_MARKS)).alias("log_text"),
        F.when(d % 5 == 0, 1).otherwise(0).alias("exit_code"),
        (d % 4 != 0).alias("has_output"),
    )
