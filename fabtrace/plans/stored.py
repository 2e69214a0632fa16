"""The lot monitor kept as a table, of which only changed lots are computed again.

Delays, figures and histories read the kept monitor instead of running it each. A refresh takes
a mark of every lot: how many rows it has, the newest time and a checksum. Lots whose mark
differs are computed and written as a new part; the latest part that has a lot counts, and files
once written stay as they are. Late, corrected and removed rows change a mark as new ones do.

The planned side (routes, operations, equipment and parameters) concerns every lot. If it changed
the monitor is built anew.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabtrace.operators.quality import table_fingerprint
from fabtrace.plans import monitor
from fabtrace.sources import commits

_PART = "_part"


def refresh(tables: monitor.LotTables, as_of: dt.datetime, root: str) -> int:
    """Bring the kept monitor up to date and return its version.

    The marks read the transactions once and shuffle a row per lot and task; nothing else is
    computed for lots that did not change. Without a change no version is made. Several
    refreshes at once are safe: the later one starts again on the result of the earlier.
    """
    spark, root = tables.transactions.sparkSession, root.rstrip("/")

    def make(log: list[commits.Entry]) -> commits.Entry | None:
        now, planned = commits.current(log), _planned(tables)
        anew = not now or now[-1].notes["planned"] != planned
        marks = _marks(tables.transactions)
        if not anew:
            marks = _changed(_latest(spark, root, now), marks, _horizon(now[-1], as_of))
        part = commits.new_part("monitor")
        marks.withColumn(_PART, F.lit(part)).write.parquet(f"{root}/{part}/marks")
        changed = spark.read.parquet(f"{root}/{part}/marks")
        if not anew and changed.isEmpty():
            return None
        rows = monitor.lot_monitor(tables.of_lots(changed.where("n > 0")), as_of, keep_order=True)
        rows.withColumn(_PART, F.lit(part)).write.parquet(f"{root}/{part}/rows")
        return commits.Entry(0, part, anew, {"planned": planned, "as_of": as_of.isoformat()})

    return commits.change(spark, root, make)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The kept monitor with its ordering columns, as ``lot_monitor`` gives it for all lots."""
    root = root.rstrip("/")
    now = commits.current(commits.entries(spark, root))
    if not now:
        raise ValueError(f"no monitor is kept at {root}")
    rows = spark.read.parquet(*[f"{root}/{e.part}/rows" for e in now])
    if len(now) == 1:
        return rows.drop(_PART)
    latest = _latest(spark, root, now).select(F.col("lot").alias("LOT"), _PART)
    return rows.join(latest, ["LOT", _PART], "left_semi").drop(_PART)


def compact(spark: SparkSession, root: str) -> int:
    """Write the kept monitor as one part, which later reads need no marks for."""
    root = root.rstrip("/")

    def make(log: list[commits.Entry]) -> commits.Entry | None:
        now = commits.current(log)
        if len(now) < 2:
            return None
        part = commits.new_part("monitor")
        marks = _latest(spark, root, now).where("n > 0")
        marks.withColumn(_PART, F.lit(part)).write.parquet(f"{root}/{part}/marks")
        latest = marks.select(F.col("lot").alias("LOT"), _PART)
        rows = spark.read.parquet(*[f"{root}/{e.part}/rows" for e in now]).join(latest, ["LOT", _PART], "left_semi")
        rows.withColumn(_PART, F.lit(part)).write.parquet(f"{root}/{part}/rows")
        return commits.Entry(0, part, True, now[-1].notes)

    return commits.change(spark, root, make)


def _marks(transactions: DataFrame) -> DataFrame:
    """(lot, n, newest, xor, total) of every lot."""
    h = F.xxhash64(*[f"`{c}`" for c in sorted(transactions.columns)])
    known = transactions.where(F.col("lot").isNotNull()).select("lot", "time_stamp", h.alias("h"))
    return known.groupBy("lot").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("time_stamp").alias("newest"),
        F.bit_xor("h").alias("xor"),
        F.sum(F.col("h").cast("decimal(20,0)")).alias("total"),
    )


def _latest(spark: SparkSession, root: str, now: list[commits.Entry]) -> DataFrame:
    """The mark of every lot in the latest part that has it; n is 0 for lots that are gone."""
    marks = spark.read.parquet(*[f"{root}/{e.part}/marks" for e in now])
    if len(now) == 1:
        return marks
    # A row per version; the parts' names are in the files, as a part is written before its version is known.
    order = F.broadcast(spark.createDataFrame([(e.part, e.version) for e in now], f"{_PART} string, version long"))
    fields = F.struct(*[c for c in marks.columns if c != "lot"])
    last = marks.join(order, _PART).groupBy("lot").agg(F.max_by(fields, "version").alias("m"))
    return last.select("lot", "m.*")


def _changed(before: DataFrame, marks: DataFrame, horizon: dt.datetime | None) -> DataFrame:
    """Marks of the lots that changed, and of the gone ones with no rows.

    With a horizon lots with anything later count as changed.
    """
    old = before.select("lot", *[F.col(c).alias(f"old_{c}") for c in ("n", "xor", "total")])
    both = marks.join(old, "lot", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    same = functools.reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in ("n", "xor", "total")]
    )
    moved_on = F.lit(False) if horizon is None else F.coalesce(F.col("newest") >= F.lit(horizon), F.lit(False))
    return both.where(~same | moved_on).select(marks.columns)


def _horizon(last: commits.Entry, as_of: dt.datetime) -> dt.datetime | None:
    """From when on rows depend on which of two days a monitor is of; None if it is the same."""
    kept = dt.datetime.fromisoformat(last.notes["as_of"])
    # A lot's last segment ends an hour after the day, so earlier rows can't tell.
    return None if kept == as_of else min(kept, as_of) + dt.timedelta(hours=1)


def _planned(tables: monitor.LotTables) -> list[list]:
    """Fingerprints of the tables that concern every lot."""
    planned = (tables.route_operations, tables.operations, tables.equipment, tables.parameters)
    return [list(table_fingerprint(t).first()) for t in planned]
