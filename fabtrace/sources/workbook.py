"""Workbooks as folders of JSON records, all values text, with a catalogue of their sheets.

Every sheet written is a part of its own. Its entry in the catalogue names the lot, the sheet and
its columns, so reading looks at no file to find the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabtrace.operators.workbook import DEFAULT_SHEET, sheet_name
from fabtrace.sources import commits
from fabtrace.sources.broken import BROKEN, broken, readable

# Names that start with an underscore are left out when a folder's files are listed.
CATALOGUE = "_catalogue"


def write_sheet(rows: DataFrame, root: str, lot: str, sheet: str) -> None:
    """One lot's sheet. Its name is kept whole; folders have no limit.

    Several sheets may be written at once; a sheet counts once the catalogue has it.
    """
    root, part = root.rstrip("/"), commits.new_part("sheets")
    named = rows.withColumns({"lot": F.lit(lot), "sheet": sheet_name(F.lit(sheet))})
    named.write.mode("errorifexists").json(f"{root}/{part}")
    own = [c for c in rows.columns if c not in ("lot", "sheet")]
    notes = {"lot": lot, "sheet": sheet or DEFAULT_SHEET, "columns": own}
    commits.add(rows.sparkSession, f"{root}/{CATALOGUE}", part, notes=notes)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per sheet and column: sheet, ordinal (in first-seen order, from 1), column_name."""
    columns: dict[str, dict[str, None]] = {}
    for entry in _catalogued(spark, root):
        columns.setdefault(entry.notes["sheet"], {}).update(dict.fromkeys(entry.notes["columns"]))
    rows = [(sheet, i, c) for sheet, own in columns.items() for i, c in enumerate(own, 1)]
    return spark.createDataFrame(rows, "sheet string, ordinal int, column_name string")


def read_sheet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of one sheet from all lots: lot, sheet and the sheet's own columns in first-seen order.

    Only this sheet's files are read, once. A sheet nobody wrote has no rows and no columns.
    """
    wanted = name or DEFAULT_SHEET
    return _read(spark, root, [e for e in _catalogued(spark, root) if e.notes["sheet"] == wanted])


def read_sheets(spark: SparkSession, root: str) -> DataFrame:
    """All sheets of all lots in one read, as text over the union of their columns.

    Columns may have another type in every file. What can't be read is left out; see
    ``unreadable``.
    """
    found = _catalogued(spark, root)
    if not found:
        raise ValueError("no sheet could be read")
    return _read(spark, root, found)


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """File and text of everything below ``root`` that is no record, catalogued or not."""
    rows = _json(spark, ["sheet"]).option("recursiveFileLookup", "true").json(root)
    return broken(rows).select(F.col("_metadata.file_name").alias("file"), F.col(BROKEN).alias("record"))


def _catalogued(spark: SparkSession, root: str) -> list[commits.Entry]:
    return commits.entries(spark, f"{root.rstrip('/')}/{CATALOGUE}")


def _read(spark: SparkSession, root: str, found: list[commits.Entry]) -> DataFrame:
    columns = dict.fromkeys(["lot", "sheet", *(c for e in found for c in e.notes["columns"])])
    parts = [f"{root.rstrip('/')}/{e.part}" for e in found]
    if not parts:
        return spark.createDataFrame([], "lot string, sheet string")
    return readable(_json(spark, columns).json(parts))


def _json(spark: SparkSession, columns):
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, BROKEN])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", BROKEN)
