import re

import pytest

from fabtrace.llm import passages
from tests.llm.data import PASSAGE, ROWS, documents, empty

SEPARATORS = {"line": r"\n+", "paragraph": r"\n[ \t\r]*\n\s*", "sentence": r"(?<=[.!?]) +|\n+"}
WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut_up(text, cut):
    """(start, end, words) of every stretch between separators."""
    at, out = 0, []
    for m in [*re.finditer(SEPARATORS[cut], text), None]:
        end = len(text) if m is None else m.start()
        if end > at:
            out.append((at, end, tuple(WORDS.findall(text[at:end].translate(LOWER)))))
        at = end if m is None else m.end()
    return out


def expected(rows, cut, least_words, least_passage):
    """What is left of each row, by going through all units in rank order with their words as keys."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, out = {}, []
    for n in order:
        doc, text = rows[n]
        found, again, before = cut_up(text or "", cut), [], None
        for i, (_, _, own) in enumerate(found):
            if not own:
                continue
            if len(own) >= least_words:
                before = own
            elif before is not None:
                before = (*before, "|", *own)
            else:
                continue
            place = first.setdefault(before, (n, i, doc))
            if place[:2] != (n, i):
                again.append((i, len(own), place[2]))
        again, passage = in_runs(again, found, least_passage), None
        passage = in_runs(again, found, 30)
        gone = {a[0] for a in again}
        source = sorted({a[2] for a in again}, key=lambda i: (i is None, i or 0))
        kept = [(a, b) for i, (a, b, _) in enumerate(found) if i not in gone]
        out.append((doc, len(found), len(gone), sum(a[1] for a in again), len(passage), source, kept))
    return out


def in_runs(again, found, least):
    runs = []
    for unit in again:
        if runs and all(not found[i][2] for i in range(runs[-1][-1][0] + 1, unit[0])):
            runs[-1].append(unit)
        else:
            runs.append([unit])
    return [u for run in runs if sum(w for _, w, _ in run) >= least for u in run]


MORE = [
    (20, "Twenty words that stand in two documents, all of them alike, so that the later one goes and none stays there."),
    (21, "Twenty words that stand in two documents, all of them alike, so that the later one goes and none stays there."),
    (22, "\n".join(["Five words make a line."] * 8)),
    (23, "First half of a long passage with enough words to count as one.\n***\n\nSecond half of it, which has "
         "again quite a number of words, more than fifteen at least. Yes."),
    (24, "First half of a long passage with enough words to count as one.\n***\n\nSecond half of it, which has "
         "again quite a number of words, more than fifteen at least. Yes. Yes. Another end."),
    (None, "Yes. Only here at first, in a row without an id."),
    (None, "Only here at first, in a row without an id."),
]


@pytest.mark.parametrize(
    ("cut", "least_words", "least_passage"),
    [("sentence", 1, 1), ("line", 1, 1), ("paragraph", 1, 1), ("sentence", 6, 30), ("line", 3, 10), ("paragraph", 1, 8)],
)
def test_awkward_rows(spark, cut, least_words, least_passage):
    all_rows = [*ROWS, *MORE]
    docs = documents(spark, all_rows).coalesce(1)
    rows = passages.mark(docs, cut=cut, least_words=least_words, least_passage=least_passage).collect()
    got = [
        (r.row.doc_id, r.n_units, r.n_removed, r.removed_words, r.in_passages, list(r.kept_in), [tuple(k) for k in r.kept])
        for r in rows
    ]
    assert sorted(map(str, got)) == sorted(map(str, expected(all_rows, cut, least_words, least_passage)))
    for r in rows:
        text = r.row.text
        if not r.n_removed:
            assert r.kept_text == text
        else:
            parts = [text[a:b] for a, b in r.kept]
            assert all(p in r.kept_text for p in parts) and len(r.kept_text) < len(text)


def test_every_later_occurrence_goes(spark):
    rows = {r.row.doc_id: r for r in passages.mark(documents(spark, [*ROWS, *MORE])).collect() if r.row.doc_id is not None}
    assert rows[20].n_removed == 0 and rows[21].kept_text == "" and list(rows[21].kept_in) == [20]
    assert (rows[22].n_units, rows[22].n_removed) == (8, 7)
    # The line without words between both halves stays and does not break the passage.
    assert rows[24].kept_text.split() == ["***", "Another", "end."] and rows[24].in_passages == 4
    assert PASSAGE not in rows[10].kept_text and list(rows[10].kept_in) == [9]


def test_only_runs_of_enough_words_are_passages():
    unit = lambda n, w: {"unit": n, "words": w, "first": 1}
    rows = [unit(7, 20), unit(1, 20), unit(2, 9), unit(4, 30), unit(6, 9), unit(8, 1)]
    assert [u["unit"] for u in passages.passages(rows, 30)] == [4, 6, 7, 8]
    assert [u["unit"] for u in passages.passages(rows, 29)] == [1, 2, 4, 6, 7, 8]
    assert [u["unit"] for u in passages.passages(rows, 31, lambda i: i == 3)] == [1, 2, 4]
    assert passages.passages([], 1) == []


def test_empty_table(spark):
    assert passages.mark(empty(spark)).count() == 0
