import random

import pytest
from pyspark.sql import functions as F

from fabtrace.operators.ordered import By, Earlier, Next, Prev, Running, with_group_value, with_ordered
from fabtrace.operators.paging import page_info, page_of, with_page, with_row_number
from tests.helpers import at, rows_of

OUTPUTS = {"p": Prev("v", -1), "n": Next("v", -2), "m": Running("max", "v"), "s": Running("sum", "v"),
           "c": Running("count", "v"), "l": Running("last", "v"), "e": Earlier("v")}


@pytest.fixture(scope="module")
def rows():
    """One lot with most of the rows, a null lot, null and equal times, null values."""
    rng = random.Random(3)
    out = []
    for i in range(900):
        lot = "HOT" if i % 3 else rng.choice(["L1", "L2", None])
        when = rng.choice([None, at(rng.randrange(40)), at(rng.randrange(40))])
        out.append((i, lot, rng.choice(["a", "b", None]), when, rng.choice([None, 1, 5, 9])))
    return out


def expected(rows, keys):
    """The same columns by a loop over each group's rows in order; nulls last."""
    groups, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[3] is None, r[3] or at(0), r[0])):
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    for own in groups.values():
        values = [r[4] for r in own]
        for i, r in enumerate(own):
            seen = [v for v in values[: i + 1] if v is not None]
            before = [v for v in values[:i] if v is not None]
            out[r[0]] = (
                values[i - 1] if i else -1,
                values[i + 1] if i + 1 < len(own) else -2,
                max(seen, default=None),
                sum(seen) if seen else None,
                len(seen),
                seen[-1] if seen else None,
                before[-1] if before else None,
            )
    return out


@pytest.mark.parametrize("keys", [["lot"], ["lot", "route"]])
def test_windows_against_a_loop(spark, rows, keys):
    df = spark.createDataFrame(rows, "id int, lot string, route string, ts timestamp_ntz, v int")
    got = with_ordered(df, ["ts", "id"], By(keys, OUTPUTS)).collect()
    names = ["id", "lot", "route", "ts", "v"]
    want = expected(rows, [names.index(k) for k in keys])
    assert {r["id"]: tuple(r[o] for o in OUTPUTS) for r in got} == want


def test_default_only_without_a_neighbour(spark):
    rows = [("L", at(0), None), ("L", at(1), 5)]
    df = spark.createDataFrame(rows, "lot string, ts timestamp_ntz, v int")
    out = with_ordered(df, ["ts"], By(["lot"], {"n": Next("v", 9999), "p": Prev("v", 7)}))
    assert rows_of(out, "v", "n", "p") == {(None, 5, 7): 1, (5, 9999, None): 1}


def test_group_value(spark):
    df = spark.createDataFrame([("L", 1), ("L", 4), (None, 2), (None, 3)], "lot string, v int")
    assert rows_of(with_group_value(df, ["lot"], F.max("v"), "g"), "v", "g") == {(1, 4): 1, (4, 4): 1, (2, 3): 1, (3, 3): 1}


def test_row_numbers(spark):
    # Several ranges, negative and equal numbers, and nulls last.
    df = spark.range(0, 700).select(
        F.when(F.col("id") % 50 != 0, (F.col("id") * 333_333) % 701_000 - 200_000).alias("ordinal"), "id"
    )
    got = with_row_number(df, ["ordinal", "id"]).collect()
    order = sorted(got, key=lambda r: (r["ordinal"] is None, r["ordinal"] or 0, r["id"]))
    assert [r["row_number"] for r in order] == list(range(1, 701))


def test_pages_rebuild_the_table(spark):
    df = spark.range(0, 401).withColumnRenamed("id", "ordinal")
    paged = with_page(df, ["ordinal"])
    assert rows_of(paged.groupBy("page").count()) == {(1, 200): 1, (2, 200): 1, (3, 1): 1}
    assert [tuple(r) for r in page_of(df, ["ordinal"], 3).collect()] == [(400, 401, 3)]
    for page in (1, 2, 3):
        assert rows_of(page_of(df, ["ordinal"], page)) == rows_of(paged.where(F.col("page") == page))
    # Out of range leaves the first page.
    for page in (4, 0, -1):
        assert tuple(page_of(df, ["ordinal"], page).first()) == (0, 1, 1)
    assert rows_of(page_info(df, 3)) == {(401, 3, 3, 401, 401): 1}
    assert rows_of(page_info(df, 9)) == {(401, 3, 1, 1, 200): 1}
    assert rows_of(page_info(df.where("ordinal < 0"))) == {(0, 1, 1, 0, 0): 1}


def test_a_page_is_found_by_a_top_k(spark):
    plan = page_of(spark.range(1000), ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
