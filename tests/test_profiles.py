import pytest
from pyspark.sql import functions as F

from fabtrace.operators import profiles, quality, trees
from fabtrace.sources import commits
from tests.helpers import rows_of

EXACT = ["ordinal", "column_name", "data_type", "row_count", "null_count", "min_value", "max_value"]


def table(spark, low, high):
    n = F.col("id")
    return spark.range(low, high).select(
        F.when(n % 5 != 0, n).alias("a.b"), (n % 40).cast("string").alias("t"), (n / 7).alias("d"), F.lit(None).cast("int").alias("none")
    )


def test_profiles_of_files_add_up(spark, tmp_path):
    path, root = str(tmp_path / "t"), str(tmp_path / "kept")
    with pytest.raises(ValueError):
        profiles.profile(table(spark, 0, 1), root)
    table(spark, 0, 3000).repartition(3).write.parquet(path)
    first = spark.read.parquet(path)
    assert profiles.add_files(first, root) == 3
    assert profiles.add_files(first, root) == 0
    table(spark, 3000, 4000).coalesce(1).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    assert profiles.add_files(whole, root) == 1  # only the new file is profiled
    assert [e.notes["files"] for e in commits.entries(spark, root)] == [3, 1]
    got = profiles.profile(whole, root)
    assert rows_of(got, *EXACT) == rows_of(quality.table_profile(whole), *EXACT)
    found = {r.column_name: r for r in got.collect()}
    assert abs(found["a.b"].approx_distinct - 3200) < 3200 * 0.08 and abs(found["t"].approx_distinct - 40) <= 2
    assert [abs(q - x) < 4000 * 0.05 for q, x in zip(found["a.b"].quantiles, (1000, 2000, 3000), strict=True)] == [True] * 3
    assert found["t"].quantiles is None and found["none"].quantiles is None
    assert found["none"].approx_distinct == 0


def test_files_that_are_gone_count_no_more(spark, tmp_path):
    root = str(tmp_path / "kept")
    for name, rows in (("x", (0, 50)), ("y", (50, 60))):
        table(spark, *rows).coalesce(1).write.parquet(str(tmp_path / name))
    both, one = (spark.read.parquet(*[str(tmp_path / n) for n in names]) for names in ("xy", "y"))
    assert profiles.add_files(both, root) == 2
    assert profiles.add_files(one, root) == 0
    assert rows_of(profiles.profile(one, root), *EXACT) == rows_of(quality.table_profile(one), *EXACT)


# ---- fingerprint trees -----------------------------------------------------------------------


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


BASE = [(i * 3, f"v{i}") for i in range(-200, 400)] + [(None, "n"), (6, "twice"), (10**15, "far")]


def changes(spark, old, new, **kw):
    a, b = keyed(spark, old), keyed(spark, new)
    kw = {"width": 16, "levels": 3} | kw
    found = trees.changed_keys(a, b, "k", trees.tree(a, "k", **kw), trees.tree(b, "k", **kw), **kw)
    return {r.key: r.change for r in found.collect()}


def test_changed_keys_are_found(spark):
    assert changes(spark, BASE, BASE[::-1]) == {}
    new = [(k, "other" if k == 30 else None if k == 10**15 else v) for k, v in BASE if k not in (-9, None)]
    new += [(7, "new"), (6, "twice")]  # a new key and a repeated row
    assert changes(spark, BASE, new) == {
        30: "changed", 10**15: "changed", -9: "removed", None: "removed", 7: "added", 6: "changed",
    }
    assert changes(spark, [], BASE[:3]) == {-600: "added", -597: "added", -594: "added"}


def test_only_differing_ranges_are_read(spark):
    a, b = keyed(spark, BASE), keyed(spark, [(k, "x" if k in (30, 33, 900) else v) for k, v in BASE])
    old, new = (trees.tree(t, "k", 16, 3) for t in (a, b))
    nodes = trees.changed_nodes(old, new, 3)
    assert sorted(r.node for r in nodes.collect()) == [1, 2, 56]
    assert trees.intervals(nodes, 16) == ([(16, 47), (896, 911)], False)
    assert trees.intervals(nodes, 16, most=1) == ([(16, 911)], False)
    read = b.where(trees.within(F.col("k"), trees.intervals(nodes, 16)))
    assert read.count() == 15


def test_larger_ranges_sum_up_smaller_ones(spark):
    found = trees.tree(keyed(spark, BASE), "k", 16, 4)
    assert {r.n for r in found.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {len(BASE)}
    assert found.where("level = 3").count() < found.where("level = 0").count()
    assert trees.tree(keyed(spark, []), "k").count() == 0
