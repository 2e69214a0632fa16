"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabtrace.llm.common import drop, stored


def components(links: DataFrame) -> DataFrame:
    """(n, component) of every n in the links (a, b): the least n it is connected with.

    Every round takes the least label among a row's neighbours and then that label's own; the
    labels are written to the shared folder after each, until none changes.
    """
    edges, edges_path = stored(
        links.select("a", "b").union(links.select("b", "a")).distinct()
    )
    labels, path = stored(
        edges.groupBy(F.col("a").alias("n")).agg(F.least(F.col("n"), F.min("b")).alias("component"))
    )
    while True:
        near = edges.join(labels.withColumnRenamed("n", "b"), "b").groupBy(F.col("a").alias("n"))
        low = labels.join(near.agg(F.min("component").alias("near")), "n").select(
            "n", F.col("component").alias("old"), F.least("component", "near").alias("low")
        )
        own = labels.select(F.col("n").alias("low"), "component")
        new, new_path = stored(low.join(own, "low").select("n", "old", "component"))
        changed = new.where("old != component").limit(1).count()
        drop(links.sparkSession, path)
        labels, path = new.select("n", "component"), new_path
        if not changed:
            drop(links.sparkSession, edges_path)
            return labels
