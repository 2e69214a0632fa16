"""Table scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_database_table(spark: SparkSession, table: str, options: Mapping[str, str]) -> DataFrame:
    """A table behind a database connection.

    ``options`` carries url, user, password, driver and, for a parallel read,
    partitionColumn, lowerBound, upperBound and numPartitions.
    """
    return spark.read.format("jdbc").options(dbtable=table, **options).load()


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """A SQL read with named parameters (``:lot``), never spliced into the text."""
    return spark.sql(sql, args=parameters)
