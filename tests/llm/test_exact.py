from collections import defaultdict

from fabtrace.llm import exact
from tests.llm.data import ROWS, documents, empty


def expected():
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(ROWS):
        groups[(text or "").encode().lower()].append((-1 if doc is None else doc, -i))
    out = []
    for rows in groups.values():
        best = max(rows)
        for r in rows:
            out.append((r[0], best[0], len(rows), r == best))
    return sorted(out)


def marked(spark, **kw):
    found = exact.mark(documents(spark).coalesce(1), **kw).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in found)


def test_equal_texts(spark):
    assert marked(spark) == expected()


def test_several_passes_and_a_crowded_filter_change_nothing(spark):
    # 32 cells for 15 rows and four passes: many rows pass the filter without a partner.
    assert marked(spark, most_cells=1 << 5) == expected()


def test_kept_rows_have_their_own_columns(spark):
    docs = documents(spark)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(t or "").encode().lower() for _, t in ROWS})


def test_empty_table(spark):
    assert exact.mark(empty(spark)).count() == 0
