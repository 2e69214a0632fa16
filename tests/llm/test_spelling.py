import re
import zlib
from collections import Counter

from fabtrace.llm import spelling
from fabtrace.llm.queries import QUERIES
from fabtrace.sources.tables import read_table
from tests.llm.data import documents, empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slipped_words(rows):
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            yield run[:at] + run[at + 1 :] if h % 97 == 0 else run


def one_less(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def is_near(a, b):
    """By definition: the longer without one code point, or one replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in one_less(b) if len(a) < len(b) else b in one_less(a)


def expected(counts, near):
    """(word, form, root, n, n_near, form_n) by following the definitions one by one."""
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def all_pairs(counts):
    return {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in counts}


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in read_table(spark, small, "documents").select("doc_id", "text").collect()]
    counts = Counter(w for w in slipped_words(rows) if len(w) >= 5)
    counts = {w: n for w, n in counts.items() if n >= 3}
    found = {tuple(r) for r in QUERIES["op12_spelling_variants"](spark, small).collect()}
    assert found == expected(counts, all_pairs(counts))
    assert any(r[1] for r in found) and any(r[2] not in (r[0], r[1]) for r in found)


def marked(spark, counts):
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    rows = [tuple(r) for r in spelling.variants(words).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_every_edit_of_every_length(spark):
    base = ["abcde", "aaaaa", "ééééé", "ab×de", "abcdef", "abcdefghi", "z" * 200]
    counts = {}
    for n, w in enumerate(base):
        for v in [w, *one_less(w), *(w[:i] + "q" + w[i:] for i in range(len(w) + 1)),
                  *(w[:i] + "q" + w[i + 1 :] for i in range(len(w)))]:
            if len(v) >= 5 and len(counts) < 500:
                counts.setdefault(v, 3 + 7 * n + len(counts) % 40)
    assert marked(spark, counts) == expected(counts, all_pairs(counts))


def test_many_words_with_a_common_half(spark):
    letters = "abcdefghij"
    counts = {f"{a}{b}{c}station": 3 + i for i, (a, b, c) in enumerate((a, b, c) for a in letters for b in letters for c in "xyz")}
    assert marked(spark, counts) == expected(counts, all_pairs(counts))


def test_ties_and_chains(spark):
    counts = {"paper": 3, "papers": 6, "papery": 6, "papersx": 12, "papersxy": 24, "other": 5}
    rows = {r[0]: r for r in marked(spark, counts)}
    assert rows["paper"] == ("paper", "papers", "papersxy", 3, 2, 6)
    assert rows["papery"][1:] == (None, "papery", 6, 2, None)  # papers occurs as often, not twice as often
    assert rows["other"] == ("other", None, "other", 5, 0, None)


def test_awkward_documents(spark):
    found = spelling.with_slips(spelling.runs(documents(spark)))
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    assert Counter(r.word for r in found.collect()) == Counter(slipped_words(rows))
    none = spelling.vocabulary(spelling.with_slips(spelling.runs(empty(spark))))
    assert spelling.variants(none).count() == 0
    odd = spark.createDataFrame([(None, 4), ("words", 4)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(odd).collect()] == [("words", None, "words", 4, 0, None)]
