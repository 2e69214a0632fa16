import hashlib
import random

from pyspark.sql import functions as F

from fabtrace.llm import decontaminate
from tests.llm.data import ROWS, documents, empty

ITEMS = [
    (1, "One two three"),
    (2, " ".join(f"shared{i}" for i in range(5, 30))),
    (3, None),
    (4, "!!"),
    (None, "seven, EIGHT"),
    (2, "seven eight"),
    (5, "中文"),
    (5, "中文"),
]
NAMED = [
    ("a\tb", "One two three"), ("c\nd\r", "seven eight"), ("", "One two"), (None, "two three"), ('"', "four five"),
    ("\\", "école"), ("a", "été"),
]


def brute(items, text):
    w = decontaminate.words(text.encode() if text else None)
    hit, names = set(), set()
    for item, passage in items:
        p = decontaminate.words(passage.encode() if passage else None)
        for i in range(max(1, len(p) - 12) if p else 0):
            window = p[i : i + 13]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    names.add(item if item is None else str(item))
    return len(w), len(hit), sorted(n or "" for n in names), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_search_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 5]))]
        pick = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        items = [(i, pick(rng.choice([1, 2, 3, 12, 13, 14, 20]))) for i in range(4)]
        text = pick(60)
        rows = [
            (b" ".join(decontaminate.words(t.encode())[i : i + 13]).decode(), str(k))
            for k, t in items
            for i in range(max(1, len(t.split()) - 12))
        ]
        w, hit, names = decontaminate.words(text.encode()), set(), set()
        for s in decontaminate.build(rows):
            for start, found in s.search(w):
                hit.update(range(start, start + s.length))
                names |= found
        assert (len(w), len(hit), sorted(names)) == brute(items, text)[:3]


def test_awkward_rows_in_one_block_and_several(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = [brute(ITEMS, t) for _, t in ROWS]
    want = sorted((n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest(), c) for n, h, k, c in want)
    for size in (decontaminate.WINDOWS_PER_BLOCK, 3):
        blocks = decontaminate.blocks_of(decontaminate.windows_of(benchmark), size)
        assert (len(blocks) > 1) == (size == 3)
        found = documents(spark).select(decontaminate.find(F.col("text"), blocks).alias("f")).select("f.*").collect()
        assert sorted(map(tuple, found)) == want


def test_ids_of_any_text(spark):
    benchmark = spark.createDataFrame(NAMED, "item_id string, text string")
    want = [brute(NAMED, t) for _, t in ROWS]
    want = sorted((n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest(), c) for n, h, k, c in want)
    for size in (100, 2):
        blocks = decontaminate.blocks_of(decontaminate.windows_of(benchmark), size)
        found = documents(spark).select(decontaminate.find(F.col("text"), blocks).alias("f")).select("f.*").collect()
        assert sorted(map(tuple, found)) == want


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.keep_clean(documents(spark), nothing).count() == len(ROWS)
    assert decontaminate.keep_clean(empty(spark), nothing).count() == 0
