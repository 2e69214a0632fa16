"""Table profiles that add up: a sketch per file, kept, and merged when asked.

A file is profiled once. What is kept of a column adds up exactly for counts and extremes, and
as mergeable sketches for the number of different values and for quantiles. A profile reads
the sketches only, so a table that got one more file costs that file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField

from fabtrace.sources import commits

# Sizes of the sketches: a distinct count is off by 1.6 % (one standard error), a quantile by
# 1.7 % of the rows.
DISTINCT_BITS = 12
QUANTILE_K = 200
# Files profiled by one version at most; their names come to the driver.
FILES_AT_ONCE = 10_000


def _sketch(field: StructField) -> Column:
    """A struct of what is kept of a column."""
    c = F.col(f"`{field.name}`")
    text = c if isinstance(field.dataType, StringType) else c.cast("string")
    parts = [
        F.count(c).alias("known"),
        F.min(c).alias("least"),
        F.max(c).alias("largest"),
        F.hll_sketch_agg(text, F.lit(DISTINCT_BITS)).alias("values"),
    ]
    if isinstance(field.dataType, NumericType):
        parts.append(F.kll_sketch_agg_double(c.cast("double"), QUANTILE_K).alias("spread"))
    return F.struct(*parts)


def file_profiles(df: DataFrame) -> DataFrame:
    """One row per file of a table read from files: file, n, and a struct ``c<i>`` per column."""
    file = F.col("_metadata.file_path").alias("file")
    own = [_sketch(f).alias(f"c{i}") for i, f in enumerate(df.schema)]
    return df.select(file, "*").groupBy("file").agg(F.count(F.lit(1)).alias("n"), *own)


def add_files(df: DataFrame, root: str) -> int:
    """Profile the files of a table that aren't yet, and return how many there were.

    Of the others no column is read. A file is known by its path; one written anew has to have a new one,
    as Spark's have. Files removed since count no more.
    """
    spark, added = df.sparkSession, 0
    name = F.col("_metadata.file_path")
    files = {r.file for r in df.select(name.alias("file")).distinct().toLocalIterator()}

    def make(log: list[commits.Entry]) -> commits.Entry | None:
        nonlocal added
        kept = _kept(spark, root, log)
        known = set() if kept is None else {r.file for r in kept.select("file").toLocalIterator()}
        new, gone = sorted(files - known)[:FILES_AT_ONCE], known - files
        added = len(new)
        if not new and not gone:
            return None
        part = commits.new_part("profile")
        fresh = None
        if new:
            fresh = file_profiles(df.where(name.isin(new)))
        if gone:  # written again without them
            left = kept.join(F.broadcast(spark.createDataFrame([(f,) for f in gone], "file string")), "file", "left_anti")
            fresh = left if fresh is None else left.unionByName(fresh)
        fresh.write.parquet(f"{root.rstrip('/')}/{part}")
        return commits.Entry(0, part, replaces=bool(gone), notes={"files": len(new)})

    total = 0
    while True:
        commits.change(spark, root, make)
        total += added
        if added < FILES_AT_ONCE:
            return total


def profile(df: DataFrame, root: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column from what is kept: place, name, type, rows, nulls, extremes as text,
    approximate number of different values, and approximate quantiles (null for texts).

    ``df`` only names the columns; no row of it is read.
    """
    spark = df.sparkSession
    kept = _kept(spark, root, commits.entries(spark, root))
    if kept is None:
        raise ValueError(f"no profile is kept at {root}")
    rows = []
    for i, field in enumerate(df.schema):
        known, values = F.sum(f"c{i}.known"), F.hll_union_agg(f"c{i}.values")
        spread = F.lit(None).cast("array<double>")
        if isinstance(field.dataType, NumericType):
            merged = F.kll_merge_agg_double(f"c{i}.spread")
            ranks = F.array(*[F.lit(float(q)) for q in quantiles])
            spread = F.when(known > 0, F.kll_sketch_get_quantile_double(merged, ranks))
        rows.append(
            F.struct(
                F.lit(i + 1).alias("ordinal"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum("n") - known, F.lit(0)).alias("null_count"),
                F.min(f"c{i}.least").cast("string").alias("min_value"),
                F.max(f"c{i}.largest").cast("string").alias("max_value"),
                F.coalesce(F.hll_sketch_estimate(values), F.lit(0)).alias("approx_distinct"),
                spread.alias("quantiles"),
            )
        )
    return kept.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def _kept(spark: SparkSession, root: str, log: list[commits.Entry]) -> DataFrame | None:
    parts = [f"{root.rstrip('/')}/{e.part}" for e in commits.current(log)]
    return spark.read.parquet(*parts) if parts else None
