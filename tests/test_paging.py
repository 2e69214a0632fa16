import datetime as dt

import pytest
from pyspark.sql import functions as F

from fabtrace.operators import paging


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would otherwise be put into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


TEXTS = ["b", None, "a", "c", "a", None, "ä", ""]


def table(spark, n=400):
    """Many ties in the first two columns; the third tells rows apart."""
    rows = [
        (TEXTS[i % 8], None if i % 7 == 0 else dt.datetime(2024, 1, 1 + i % 3), i * 7919 % n, {"m": i})
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "text string, `at.x` timestamp_ntz, id long, extra map<string,int>").repartition(6)


def key(row, order, descending):
    out = []
    for c in order:
        v = row[c]
        if v is None:
            out.append((1, 0))
        elif isinstance(v, str):
            code = [ord(x) for x in v]
            out.append((0, [-x for x in code] + [1] if c in descending else code))
        elif isinstance(v, dt.datetime):
            out.append((0, -v.timestamp() if c in descending else v.timestamp()))
        else:
            out.append((0, -v if c in descending else v))
    return out


def in_order(df, order, descending=()):
    """Rows by definition: the order, then the other columns that can be compared."""
    others = [c for c in df.columns if c not in order and c != "extra"]
    return sorted((r.asDict() for r in df.collect()), key=lambda r: key(r, [*order, *others], descending))


ORDERS = [
    (["id"], []),
    (["text"], []),
    (["at.x"], ["at.x"]),
    (["text", "at.x"], ["text"]),
    (["at.x", "text", "id"], ["at.x", "id"]),
]


@pytest.mark.parametrize("order,descending", ORDERS)
def test_numbers_pages_and_reading_on(spark, order, descending):
    df = table(spark)
    rows = in_order(df, order, descending)
    numbered = paging.with_page(df, order, 30, descending).collect()
    assert sorted((r["row_number"], r["id"], r["page"]) for r in numbered) == [
        (i + 1, r["id"], i // 30 + 1) for i, r in enumerate(rows)
    ]
    kept = paging.ranked(df, order, descending)
    assert kept.total == 400 and len(kept.ranges) > 1
    for page in (1, 2, 9, 14):
        got = [tuple(r) for r in paging.page_of(kept, order, page, 30).collect()]
        want = rows[(page - 1) * 30 : page * 30]
        assert [(r[2], r[-2], r[-1]) for r in got] == [(r["id"], (page - 1) * 30 + i + 1, page) for i, r in enumerate(want)]
    assert [r["id"] for r in paging.page_of(kept, order, 15, 30).collect()] == [r["id"] for r in rows[:30]]
    if order[-1] == "id":
        last, seen = None, []
        while True:
            page = [r.asDict() for r in paging.page_after(df, order, last, 90, descending).collect()]
            seen += [r["id"] for r in page]
            if not page:
                break
            last = page[-1]
        assert seen == [r["id"] for r in rows]


@pytest.mark.parametrize("top", [paging.TOP_ROWS, 50])
def test_pages_of_a_table(spark, monkeypatch, top):
    monkeypatch.setattr(paging, "TOP_ROWS", top)
    df = table(spark, 90)
    rows = in_order(df, ["text"])
    for number, start in ((1, 0), (2, 40), (3, 80), (4, 0), (0, 0), (-3, 0)):
        got = paging.page_of(df, ["text"], number, 40).collect()
        assert [(r["id"], r["row_number"]) for r in got] == [(r["id"], start + i + 1) for i, r in enumerate(rows[start : start + 40])]
        assert {r["page"] for r in got} == {start // 40 + 1}


def test_empty_table(spark):
    none = table(spark).where("id < 0")
    assert paging.with_page(none, ["text"]).count() == 0
    assert paging.page_of(none, ["text"], 3).count() == 0
    assert paging.page_after(none, ["text"], {"text": "a"}).count() == 0
    assert paging.page_of(paging.ranked(none, ["text"]), [], 1).columns[-2:] == ["row_number", "page"]


def test_sparse_numbers_stay_in_few_ranges(spark):
    df = spark.range(20_000).select((F.xxhash64("id")).alias("key"))
    kept = paging.ranked(df, ["key"])
    assert len(kept.ranges) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(n for _, n in kept.ranges) < 20_000 / 2
    page = paging.page_of(kept, ["key"], 60)
    assert [r.row_number for r in page.collect()] == list(range(11_801, 12_001))


def test_a_deep_page_reads_its_rows_only(spark):
    kept = paging.ranked(spark.range(20_000), ["id"])
    plan = paging.page_of(kept, ["id"], 60)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_place" in plan


def test_reading_on_reaches_the_scan(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    orders = spark.read.parquet(f"{small}/orders.parquet")
    last = {"o_orderpriority": "3-MEDIUM", "o_orderkey": 5}
    plan = paging.page_after(orders, list(last), last)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(o_orderpriority,3-MEDIUM)" in plan
    last = {"o_orderdate": dt.datetime(1996, 1, 1), "o_orderkey": 5}
    assert "cast(o_orderdate" not in paging.page_after(orders, list(last), last)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
