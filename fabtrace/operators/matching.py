"""Planned operations matched with the moves made during their route segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabtrace.operators.route import NO_ROUTE


def match_moves(moves: DataFrame, route: DataFrame) -> DataFrame:
    """Every planned operation with each of its moves, or once without when it has none.

    Move columns come back with the prefix ``l_``, planned ones with ``r_``.  Moves outside
    the planned route drop out.
    """
    left = moves.select(
        *[F.col(c).alias(f"l_{c}") for c in moves.columns],
        F.coalesce("route", F.lit(NO_ROUTE)).alias("l_route_key"),
    )
    right = route.select(
        *[F.col(c).alias(f"r_{c}") for c in route.columns],
        F.coalesce("route", F.lit(NO_ROUTE)).alias("r_route_key"),
    )
    # Catalyst keeps the hash partitioning of both sides through the join, the grouping
    # and the windows that follow, as all of them are keyed by lot and operation.
    return left.join(
        right.repartition("r_lot", "r_operation"),
        (F.col("l_lot") == F.col("r_lot"))
        & (F.col("l_operation") == F.col("r_operation"))
        & (F.col("l_facility") == F.col("r_facility"))
        & (F.col("l_route_key") == F.col("r_route_key"))
        & (F.col("l_segment_start") == F.col("r_route_order_seq"))
        & (F.col("l_trans_time") < F.col("r_route_leave_time_stamp")),
        "right",
    )
