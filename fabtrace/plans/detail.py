"""The history of the operations that made each lot late."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from fabtrace.operators.history import operations_to_show, union_history


def delayed_history(
    summary: DataFrame, sources: Mapping[str, DataFrame | None], opened: DataFrame | None = None
) -> DataFrame:
    """History rows of every lot's delayed operations, or of the opened one without any.

    The union of the sources is joined once, so the monitor behind the summary runs once.
    """
    return union_history(sources, operations_to_show(summary, opened))
