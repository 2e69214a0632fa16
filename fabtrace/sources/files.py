"""File sinks for results and the matching readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_csv(df: DataFrame, path: str) -> None:
    """Rows with a header line and no index column."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, line_feeds_in_cells: bool = True
) -> DataFrame:
    """Rows written by ``write_csv``.

    A cell may hold line feeds, so a file is read by one task from its start. Say where no cell
    does, and several tasks share a large file.
    """
    # An unquoted empty cell is null and a quoted one is empty text, as written above; the
    # reader needs a null mark other than the empty text to keep them apart.
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", line_feeds_in_cells)
        .option("nullValue", "\x00")
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
