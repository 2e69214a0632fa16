"""The annotation table, kept as JSON records behind a log of versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabtrace.sources import commits
from fabtrace.sources.broken import BROKEN, broken, readable
from fabtrace.sources.schemas import ANNOTATION_COLUMNS

_SCHEMA = ", ".join(f"`{c}` string" for c in ANNOTATION_COLUMNS)


def clean(df: DataFrame) -> DataFrame:
    """The five columns in order as text; missing ones and unknown values become empty."""
    columns = []
    for name in ANNOTATION_COLUMNS:
        if name in df.columns:
            text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
            columns.append(F.when(text.isin("nan", "None"), "").otherwise(text).alias(name))
        else:
            columns.append(F.lit("").alias(name))
    return df.select(*columns)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of annotation records; empty when the path is missing.

    Broken files and records are left out; ``record_errors`` lists them.
    """
    return clean(readable(_records(spark, path)))


def record_errors(spark: SparkSession, path: str) -> DataFrame:
    """Text of every file or record that can't be read, with what could be read of its lot."""
    return broken(_records(spark, path)).select(F.col(BROKEN).alias("record"), "LOT NUMBER")


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """The latest version written; empty when there is none.

    A damaged record is an error: the next change would lose it for good.
    """
    return _read_parts(spark, path, commits.entries(spark, path))


def save(annotations: DataFrame, path: str) -> None:
    """Make these rows the table, in place of whatever it holds.

    They may come from the earlier version, whose files stay. To keep what other writers add
    meanwhile use ``add`` or ``update``.
    """
    part = _write_part(annotations, path)
    commits.add(annotations.sparkSession, path, part, replaces=True)


def add(rows: DataFrame, path: str) -> None:
    """Add rows to the saved table; only they are written."""
    commits.add(rows.sparkSession, path, _write_part(rows, path))


def update(
    spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int | None = None
) -> None:
    """Save what ``change`` makes of the table.

    If another writer saves or adds meanwhile, the change is made again on the newer table.
    """

    def make(log: list[commits.Entry]) -> commits.Entry:
        part = _write_part(change(_read_parts(spark, path, log)), path)
        return commits.Entry(0, part, replaces=True)

    commits.change(spark, path, make, tries)


def _write_part(rows: DataFrame, path: str) -> str:
    part = commits.new_part()
    clean(rows).write.mode("errorifexists").json(f"{path.rstrip('/')}/{part}")
    return part


def _read_parts(spark: SparkSession, path: str, log: list[commits.Entry]) -> DataFrame:
    parts = [f"{path.rstrip('/')}/{e.part}" for e in commits.current(log)]
    if not parts:
        return spark.createDataFrame([], _SCHEMA)
    return clean(spark.read.schema(_SCHEMA).option("mode", "FAILFAST").json(parts))


def _records(spark: SparkSession, path: str) -> DataFrame:
    return _unless_missing(
        spark,
        f"{_SCHEMA}, {BROKEN} string",
        lambda r: r.option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).json(path),
    )


def _unless_missing(spark: SparkSession, schema: str, read) -> DataFrame:
    """What ``read`` gives; no rows if there is no such path. Other errors pass."""
    try:
        return read(spark.read.schema(schema))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
