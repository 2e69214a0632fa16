import random

import numpy as np
import pytest

from fabtrace.llm import common, lines
from fabtrace.llm.decontaminate import words
from fabtrace.llm.shingles import hashed_words
from tests.llm.data import ROWS, documents, empty


def brute(rows, least=0.8):
    """(doc_id, n_lines, {removed line: its earlier matches}) of each row; rows are in rank order."""
    lines = []
    for n, (_, text) in enumerate(rows):
        for i, line in enumerate(text.split("\n") if text else []):
            if s := frozenset(words(line.encode())):
                lines.append((n, i, s))
    out = []
    for n, (doc, text) in enumerate(rows):
        removed = {}
        for m, i, s in lines:
            if m == n:
                alike = {
                    (rows[k][0], j)
                    for k, j, t in lines
                    if (k, j) < (n, i) and len(s & t) >= least * len(s | t) - 1e-9
                }
                if alike:
                    removed[i] = alike
        out.append((doc, len(text.split("\n")) if text else 0, text, removed))
    return out


def check(docs, rows):
    """Every line that has an earlier match goes, and the match named is one of them."""
    found = lines.mark(docs).select("row.doc_id", "n_lines", "row.text", "removed", "kept_text").collect()
    key = lambda r: str((r[0], r[2], sorted(x[0] for x in r[3])))
    want = [(doc, n, text, [(i,) for i in removed], removed) for doc, n, text, removed in brute(rows)]
    assert len(found) == len(want)
    for got, (doc, n, text, gone, removed) in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert (got[0], got[1], got[2], [r[0] for r in got[3]]) == (doc, n, text, sorted(x[0] for x in gone))
        for r in got[3]:
            assert (r[1], r[2]) in removed[r[0]]
        split = text.split("\n") if text else []
        assert got[4] == (text if not gone else "\n".join(x for i, x in enumerate(split) if i not in removed))
    return sum(len(w[3]) for w in want)


def family(n_docs, changes, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    stock = [rng.sample(vocabulary, rng.randint(1, 15)) for _ in range(25)]
    rows = []
    for d in range(n_docs):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(stock))
            for _ in range(rng.choice(changes)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rng.shuffle(line)
            text.append(" ".join(line))
        rows.append((d, "\n".join(text)))
    return rows


@pytest.mark.parametrize("partners", [1, 2])
def test_random_lines_against_all_pairs(spark, monkeypatch, partners):
    monkeypatch.setattr(lines, "PARTNERS", partners)
    rows = family(60, [0, 0, 1, 1, 2], 8)
    assert check(documents(spark, rows).repartition(4), rows) > 50


def test_false_candidates_lead_to_a_second_search(spark, monkeypatch):
    """Without the bitmap many candidates are false; what they hide is found again."""
    searched = []
    again = lines._search_again
    monkeypatch.setattr(lines.Sets, "bitmap", lambda self: np.zeros(len(self.first), np.uint64))
    monkeypatch.setattr(lines, "PARTNERS", 1)
    monkeypatch.setattr(lines, "_search_again", lambda *a: searched.append(1) or again(*a))
    rows = family(120, [1, 2, 3], 9)
    assert check(documents(spark, rows).repartition(3), rows) > 50
    assert searched


def test_awkward_rows(spark):
    ranked = [r for _, r in sorted(enumerate(ROWS), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0]))]
    assert check(documents(spark).coalesce(1), ranked)


def test_order_is_the_same_by_either_way(monkeypatch):
    rng = np.random.default_rng(1)
    line = np.sort(rng.integers(0, 50, 2000))
    hashes = rng.integers(0, 40, 2000).astype(np.uint64) << np.uint64(58)
    rarity = rng.integers(0, 3, lines.COUNT_CELLS).astype(np.uint32)
    for table in (None, rarity):
        short = [(line[i], 0 if table is None else table[lines.cells(hashes[i : i + 1])[0]], hashes[i]) for i in lines._order(line, hashes, table)]
        assert short == sorted(short)


def test_empty_table(spark):
    assert lines.mark(empty(spark)).count() == 0


def test_sets_do_not_depend_on_their_neighbours():
    texts = [b"", b"\n\na b\n", b"b a a", b"..", b"c\nd\n\ne f"]
    together = lines.Sets(texts)
    assert list(zip(together.text.tolist(), together.line.tolist(), strict=True)) == [(1, 2), (2, 0), (4, 0), (4, 1), (4, 3)]
    assert together.a[0] == together.a[1] and len(np.unique(together.a)) == 4
    assert together.size.tolist() == [2, 2, 1, 1, 2]


def test_words_are_hashed_eight_bytes_at_a_time():
    text = "One, one ONE\n abcdefgh abcdefghi abcdefghj 中文中文中文 a\n".encode()
    hashes, at = lines.word_hashes(text)
    assert at.tolist() == hashed_words(text)[1].tolist()
    assert hashes[0] == hashes[1] == hashes[2] and len(np.unique(hashes)) == 6
    assert len(lines.word_hashes(b"")[0]) == len(lines.word_hashes(b" .\n")[0]) == 0


@pytest.mark.parametrize("least", [0.5, 0.7, 0.8, 0.9])
def test_similar_sets_are_sent_under_a_common_run(least):
    """Whatever other runs occur again; sets of 1 to 80 words, changed as much as may be."""
    rng = random.Random(7)
    pairs = 0
    for _ in range(3000):
        x = [f"w{i}" for i in rng.sample(range(500), rng.randint(1, 80))]
        most = int(len(x) * (1 - least) / least) + 1
        gone = rng.randint(0, most)
        y = rng.sample(x, max(1, len(x) - gone)) + [f"v{i}" for i in range(rng.randint(0, most - gone))]
        shared, union = len(set(x) & set(y)), len(set(x) | set(y))
        if shared == union or shared < least * union:
            continue
        pairs += 1
        a, b = (lines.Sets([" ".join(t).encode()]) for t in (x, y))
        runs = [lines._runs(s, np.arange(1), least) for s in (a, b)]
        both = np.intersect1d(runs[0][0], runs[1][0])
        sent = []
        for run, _, of, need in runs:
            again = np.isin(run, both) | (np.random.default_rng(pairs).random(len(run)) < 0.3)
            sent.append(run[again][lines._under(run[again], of[again], need[again])])
        assert len(np.intersect1d(*sent))
    assert pairs > 300


def test_lines_alone_are_not_sent(spark, monkeypatch):
    """Words that many lines have make no rows; only runs that occur again do."""
    sent = []
    find = lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda posts, *a: sent.append(posts.agg({"runs": "sum"}).first()[0]) or find(posts, *a))
    rng = random.Random(4)
    rows = [(d, " ".join(f"w{rng.randrange(2000)}" for _ in range(40))) for d in range(300)]
    rows += [(300, rows[7][1] + " more")]
    assert check(documents(spark, rows).repartition(3), rows) == 1
    assert 0 < sent[0] < 300


def test_sets_are_sent_under_their_rarest_runs():
    """Common words that many lines end with must not bring these together."""
    rarity = np.zeros(lines.COUNT_CELLS, np.uint32)
    text = b" ".join(b"w%d" % i for i in range(25))
    rarity[lines.cells(lines.Sets([text]).words)] = 1 + np.random.default_rng(3).permutation(25).astype(np.uint32)
    s = lines.Sets([text], rarity)
    run, place, of, shared = lines._runs(s, np.arange(1), 0.8)
    sent = place[lines._under(run, of, shared)]
    assert len(sent) == len(run) - shared[0] + 1 < len(run)
    assert sorted(sent) == list(range(len(sent)))


def test_only_runs_with_more_candidates_are_kept_for_the_next_search(spark, monkeypatch):
    """The first search leaves no table of all postings behind, and the next one reads less."""
    sent = []
    find = lines.candidates
    monkeypatch.setattr(lines.Sets, "bitmap", lambda self: np.zeros(len(self.first), np.uint64))
    monkeypatch.setattr(lines, "PARTNERS", 1)
    monkeypatch.setattr(lines, "candidates", lambda posts, *a: sent.append(posts.agg({"runs": "sum"}).first()[0]) or find(posts, *a))
    rows = family(120, [1, 2, 3], 9)
    assert check(documents(spark, rows).repartition(3), rows) > 50
    assert len(sent) > 1 and 0 < sent[1] < sent[0]


def test_sets_of_wanted_lines_only():
    texts = [b"a b\n\nc d e", b"f\ng h"]
    every = lines.Sets(texts)
    some = lines.Sets(texts, wanted=lambda text, line: (text == 1) & (line == 1) | (text == 0) & (line == 2))
    at = [1, 3]
    assert some.text.tolist() == [0, 1] and some.line.tolist() == [2, 1] and some.size.tolist() == [3, 2]
    assert (some.a == every.a[at]).all() and (some.b == every.b[at]).all()
    assert len(lines.Sets(texts, wanted=lambda text, line: text < 0).a) == 0


def test_gathered_in_few_jobs(spark):
    """However many partitions a shuffle has, most of them empty, the pieces come in one job."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    spark.sparkContext.setJobGroup("gather", "gather")
    try:
        for n, v in zip(names, ("40", "false"), strict=True):
            spark.conf.set(n, v)

        def fill(batches):
            total = np.zeros(3 * common.PIECE, np.int64)
            for batch in batches:
                np.add.at(total, batch.column(0).to_numpy(), 1)
            return total

        found = common.gather(spark.range(0, 3 * common.PIECE, 1, 4), fill, 3 * common.PIECE, np.int64)
        assert (found == 1).all()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("gather")) < 10
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_orders_are_those_of_lexsort():
    rng = np.random.default_rng(5)
    run, name = rng.integers(0, 9, 2000).astype(np.uint32), rng.integers(-(1 << 62), 1 << 62, 2000)
    for ids in (rng.integers(0, 20, 2000), rng.integers(0, 20, 2000) << 40, np.full(2000, lines.NO_ID)):
        assert (lines._by_run(run, ids, name) == np.lexsort((name, ids, run))).all()
    words = rng.permutation(2000).astype(np.uint64) | rng.integers(0, 3, 2000).astype(np.uint64) << np.uint64(60)
    for pair in (np.sort(rng.integers(0, 300, 2000)), np.zeros(2000, np.int64)):
        assert (lines._by_pair(pair, words) == np.lexsort((words, pair))).all()
    counts = np.concatenate([rng.integers(0, 99, 2000), [(1 << 20) - 1, 1 << 20, 1 << 30]])
    ranks = lines.rarities(counts)
    capped = np.minimum(counts, (1 << 20) - 1)
    assert ((ranks[:, None] < ranks) == (capped[:, None] < capped)).all() and ranks.dtype == np.uint8
