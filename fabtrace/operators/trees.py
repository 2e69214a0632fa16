"""Fingerprints that say where two tables differ.

The rows of a table with a whole-number key are put into ranges of the key. Every range has a
fingerprint that doesn't depend on row order, and ranges make up larger ones, up to a few that
cover everything. Two trees are compared from the top, and only ranges with a difference are
followed further; then only the rows of the smallest differing ranges are read and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1024
FAN = 32
LEVELS = 5
# Key intervals in the filter of a scan; more are merged with their nearest neighbours.
MOST_INTERVALS = 200


def _node(key: Column, level: int, width: int) -> Column:
    return F.floor(key / F.lit(width * FAN**level).cast("decimal(38,0)")).cast("long")


def _sums(n: Column, xor: Column, total: Column) -> list[Column]:
    return [n.alias("n"), F.bit_xor(xor).alias("xor"), F.sum(total).alias("total")]


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.struct(F.lit(i), F.col(f"`{c}`")) for i, c in enumerate(sorted(df.columns))])


def tree(df: DataFrame, key: str, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """(level, node, n, xor, total): fingerprints of the ranges of ``width`` keys (level 0) and above.

    Rows without a key make up a node of their own (null). One pass over the table; the
    larger ranges are summed from the smaller ones.
    """
    hashed = df.select(_node(F.col(f"`{key}`"), 0, width).alias("node"), _row_hash(df).alias("h"))
    leaves = hashed.groupBy("node").agg(
        *_sums(F.count(F.lit(1)), F.col("h"), F.col("h").cast("decimal(20,0)"))
    )
    out = level = leaves.select(F.lit(0).alias("level"), "node", "n", "xor", "total")
    for k in range(1, levels):
        above = level.groupBy(_node(F.col("node"), 1, 1).alias("node")).agg(
            *_sums(F.sum("n"), F.col("xor"), F.col("total"))
        )
        level = above.select(F.lit(k).alias("level"), "node", "n", "xor", "total")
        out = out.unionByName(level)
    return out


def changed_nodes(old: DataFrame, new: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(node) of the smallest ranges that differ, found from the top.

    ``old`` and ``new`` are trees of the same width, stored ones best: each level is read for
    the children of differing nodes only.
    """
    found = None
    for k in range(levels - 1, -1, -1):
        a, b = (t.where(F.col("level") == k) for t in (old, new))
        if found is not None:
            parents = found.select(F.col("node").alias("parent"))
            below = _node(F.col("node"), 1, 1).eqNullSafe(F.col("parent"))
            a, b = a.join(parents, below, "left_semi"), b.join(parents, below, "left_semi")
        b = b.select(*[F.col(c).alias(f"new_{c}") for c in ("node", "n", "xor", "total")])
        same = F.lit(True)
        for c in ("n", "xor", "total"):
            same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
        both = a.join(b, F.col("node").eqNullSafe(F.col("new_node")), "full")
        found = both.where(~same).select(F.coalesce("node", "new_node").alias("node")).distinct()
    return found


def intervals(nodes: DataFrame, width: int = WIDTH, most: int = MOST_INTERVALS) -> tuple[list[tuple[int, int]], bool]:
    """Key intervals (first, last) that cover the nodes, and whether rows without a key differ.

    Of too many the nearest are merged, which reads more rows but misses none.
    """
    found = [r.node for r in nodes.select("node").toLocalIterator()]
    spans: list[list[int]] = []
    for node in sorted(x for x in found if x is not None):
        if spans and spans[-1][1] + 1 == node * width:
            spans[-1][1] = (node + 1) * width - 1
        else:
            spans.append([node * width, (node + 1) * width - 1])
    if len(spans) > most:
        gaps = sorted(range(1, len(spans)), key=lambda i: spans[i][0] - spans[i - 1][1], reverse=True)
        cuts = sorted([0, *gaps[: most - 1], len(spans)])
        spans = [[spans[a][0], spans[b - 1][1]] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(a, b) for a, b in spans], None in found


def within(key: Column, spans: tuple[list[tuple[int, int]], bool]) -> Column:
    """Whether a key is in one of the intervals, as a condition the scan understands."""
    wanted = key.isNull() if spans[1] else F.lit(False)
    for first, last in spans[0]:
        wanted = wanted | key.between(first, last)
    return wanted


def changed_keys(
    old: DataFrame, new: DataFrame, key: str, old_tree: DataFrame, new_tree: DataFrame,
    width: int = WIDTH, levels: int = LEVELS,
) -> DataFrame:
    """(key, change): the keys whose rows differ between two tables: added, removed or changed.

    Only the differing ranges of both tables are read. Rows that share a key are compared as a
    whole, in any order.
    """
    spans = intervals(changed_nodes(old_tree, new_tree, levels), width)

    def prints(df: DataFrame, prefix: str) -> DataFrame:
        rows = df.where(within(F.col(f"`{key}`"), spans))
        hashed = rows.select(F.col(f"`{key}`").alias("key"), _row_hash(df).alias("h"))
        sums = _sums(F.count(F.lit(1)), F.col("h"), F.col("h").cast("decimal(20,0)"))
        return hashed.groupBy("key").agg(*sums).select(*[F.col(c).alias(f"{prefix}{c}") for c in ("key", "n", "xor", "total")])

    both = prints(old, "a_").join(prints(new, "b_"), F.col("a_key").eqNullSafe(F.col("b_key")), "full")
    change = (
        F.when(F.col("a_n").isNull(), "added")
        .when(F.col("b_n").isNull(), "removed")
        .when((F.col("a_n") != F.col("b_n")) | (F.col("a_xor") != F.col("b_xor")) | (F.col("a_total") != F.col("b_total")), "changed")
    )
    return both.select(F.coalesce("a_key", "b_key").alias("key"), change.alias("change")).where("change IS NOT NULL")
