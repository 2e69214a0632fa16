"""Hand-made lot tables."""

import datetime as dt
from collections import Counter

from fabtrace.plans.monitor import LotTables
from fabtrace.sources import schemas

DAY0 = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return DAY0 + dt.timedelta(hours=hours)


def frame(spark, schema: str, rows: list[dict]):
    empty = spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in rows], empty.schema)


def transactions(spark, rows: list[dict]):
    base = {
        "facility": "F", "route": "R", "deleted_flag": "N", "transcode": "MVOU", "unit_1": "WFR",
    }
    full = []
    for r in rows:
        r = base | r
        r.setdefault("date_stamp", r["time_stamp"].replace(hour=0, minute=0, second=0, microsecond=0))
        full.append(r)
    return frame(spark, schemas.TRANSACTIONS, full)


def route(spark, steps: dict[str, int], **extra):
    rows = [
        {
            "facility": "F", "route": "R", "operation": o, "operation_sequence_number": n,
            "create_date": dt.datetime(2030, 1, 1), "process_cycle_time": 0.5,
            "queue_cycle_time": 0.25, "optional_oper_flag": "N",
        } | extra.get(o, {})
        for o, n in steps.items()
    ]
    return frame(spark, schemas.ROUTE_OPERATIONS, rows)


def tables(spark, tx, ro) -> LotTables:
    return LotTables(
        tx,
        ro,
        frame(spark, schemas.OPERATIONS, []),
        frame(spark, schemas.EQUIPMENT, []),
        frame(
            spark,
            schemas.PARAMETERS,
            [
                {"var_name": "HOLD START TRANSACTION", "var_value": "HLLT"},
                {"var_name": "HOLD RELEASE TRANSACTION", "var_value": "RLLT"},
            ],
        ),
    )


def rows_of(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*(columns or [f"`{c}`" for c in df.columns])).collect())
