import random

import numpy as np
import pytest

from fabtrace.llm import near
from fabtrace.llm.decontaminate import words
from fabtrace.llm.graph import components
from tests.llm.data import ROWS, documents, empty

FLAT = np.ones(near.FREQUENCY_CELLS, np.float32)


def weighted(text):
    w = words(text)
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        k = tuple(w[i : i + 5])
        out[k] = out.get(k, 0) + 1
    return {k: 1 + np.log(v) for k, v in out.items()}


def jaccard(a, b):
    both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1e-9)


def family(seed, n, edits, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(length)] + ["same", "same", "same", "same", "same", "same"] * 2
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_similarity_of_pairs_and_of_all():
    texts = [t.encode() for t in family(1, 12, 8)] + [b"", b"one two", b"one two three"]
    bags = [weighted(t) for t in texts]
    want = np.array([[jaccard(a, b) for b in bags] for a in bags])
    others = ~np.eye(len(texts), dtype=bool)
    assert np.allclose(near.all_similar(texts, FLAT)[others], want[others])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    got = near.similarity([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs], FLAT)
    assert np.allclose(got, [want[p] for p in pairs])


def test_samples_agree_as_often_as_texts_are_similar():
    texts = [t.encode() for t in family(2, 30, 10)]
    h, t, times = near.shingles(texts)
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    names = near.samples(h, near.weights(h, times, FLAT), first, 2048)
    want = near.all_similar(texts, FLAT)
    got = np.array([[(a == b).mean() for b in names] for a in names])
    np.fill_diagonal(want, 1)
    assert np.abs(got - want).max() < 0.06 and abs((got - want).mean()) < 0.01


def test_samples_do_not_depend_on_the_batch(monkeypatch):
    texts = [t.encode() for t in family(3, 5, 4)]
    h, t, times = near.shingles(texts)
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    whole = near.samples(h, near.weights(h, times, FLAT), first)
    monkeypatch.setattr(near, "_SHINGLES_AT_ONCE", 7)
    assert (near.samples(h, near.weights(h, times, FLAT), first) == whole).all()


def brute_classes(rows, least=0.8):
    bags = [weighted((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and jaccard(a, bags[j]) >= least:
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return groups.values()


def expected(rows):
    out = []
    for members in brute_classes(rows):
        best = min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
        out += [(rows[i][0], rows[best][0], len(members), i == best) for i in members]
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [256, 4])
def test_chained_families(spark, monkeypatch, block):
    """Copies of which many are similar to some others only, in one block and in several."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "IDF_SHARE", 0.0)
    rows = []
    for seed in range(4):
        rows += family(seed + 10, 12, 6, 90)
    rows = [(i, t) for i, t in enumerate(rows)]
    got = near.mark(documents(spark, rows)).select("row.doc_id", "class_id", "class_size", "kept").collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(near, "IDF_SHARE", 0.0)
    docs = documents(spark).coalesce(1)
    got = near.mark(docs).select("row.doc_id", "class_id", "class_size", "kept").collect()
    assert sorted(str(tuple(r)) for r in got) == expected(ROWS)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_classes(ROWS))


def test_empty_table(spark):
    assert near.mark(empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.n: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
