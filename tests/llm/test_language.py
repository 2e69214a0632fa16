import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabtrace.llm import language
from fabtrace.llm.common import held_out
from tests.llm.data import documents, empty


def test_bundle_is_the_sum_of_bound_trigrams():
    letters = {c: language.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(int) for c in "ab "}
    trigrams = [" ab", "ab ", "b b", " b "]
    want = sum(np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for x, y, z in trigrams)
    assert (language.bundles(["Ab, 1 b!"])[0] == want).all()


def test_texts_do_not_touch_each_other():
    texts = ["abc def", "", "ghi", "123", "é", "abc def"]
    together, alone = language.bundles(texts), np.vstack([language.bundles([t]) for t in texts])
    assert (together == alone).all()
    assert not together[[1, 3]].any()


def test_many_letters_take_the_other_way():
    text = "".join(chr(0x4E00 + i) for i in range(300))
    assert (language.bundles([text, "abc"])[1] == language.bundles(["abc"])[0]).all()


def test_the_length_of_a_text_changes_nothing(monkeypatch):
    texts = ["abcd efgh", "", "ijklmnopqrstu", "a.. b..c", "......", "ab   " * 9, "ΑΣΟΣ ΣΑΣ", "x"]
    whole = language.bundles(texts)
    for length in (1, 2, 3, 5, 8):
        monkeypatch.setattr(language, "LONGEST_PIECE", length)
        assert (language.bundles(texts) == whole).all()
        assert (language.bundle_of_all(texts) == whole.sum(axis=0)).all()


def test_a_very_long_text_is_the_sum_of_its_trigrams():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(90_000))
    assert len(text) > language.LONGEST_PIECE
    counts = Counter(zip(f" {text}", text, f"{text} "[1:], strict=False))
    assert (language.bundles([text])[0] == summed(counts)).all()


def test_many_short_texts_of_many_letters_take_little_memory():
    rng = random.Random(4)
    texts = ["".join(chr(0x4E00 + rng.randrange(15_000)) for _ in range(26)) for _ in range(3000)]
    tracemalloc.start()
    found = language.bundles(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
    assert (found[::500] == language.bundles(texts[::500])).all()


def vector(c):
    return language.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(np.int64)


def summed(counts):
    """The weighted sum of bound trigrams, one by one."""
    total = np.zeros(language.DIMENSIONS, np.int64)
    for (x, y, z), n in counts.items():
        total += n * np.roll(vector(x), 2) * np.roll(vector(y), 1) * vector(z)
    return total


def trigrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = f" {' '.join(words)} " if words else ""
    return Counter(zip(line, line[1:], line[2:], strict=False))


def test_predictions_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").select("text", "lang").collect()
    known = [(r.text[:300], r.lang) for r in rows[:30]]
    asked = [r.text[:200] for r in rows[30:]] + ["", "123", "xyz", "É"]
    profiles = {}
    for text, lang in known:
        profiles[lang] = profiles.get(lang, 0) + summed(trigrams(text))
    prototypes = language.learn(spark.createDataFrame(known, "text string, lang string"))
    found = spark.createDataFrame([(t,) for t in asked], "text string")
    got = {r.text: r.p for r in found.select("text", language.predict(F.col("text"), prototypes, spark).alias("p")).collect()}
    for text in asked:
        own = summed(trigrams(text)).astype(float)
        if not own.any():
            assert (got[text].lang, got[text].score) == ("und", 0)
            continue
        cosine = {n: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for n, p in profiles.items()}
        best = max(cosine.values())
        assert cosine[got[text].lang] > best - 1e-4 and abs(got[text].score - max(best, 0)) < 1e-4


@pytest.fixture(scope="module")
def prototypes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return language.learn(docs.where(~held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, small, prototypes):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(held_out(F.col("doc_id")))
    found = docs.select("lang", language.predict(F.col("text"), prototypes, spark).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang for r in found]) > 0.95
    assert all(0 <= r.p.score <= 1 for r in found)


def test_awkward_rows(spark, prototypes):
    docs = documents(spark)
    found = docs.select("text", language.predict(F.col("text"), prototypes, spark).alias("p")).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r.p.lang == "und") == (not any(c.isalpha() for c in r.text or ""))
    kept = language.keep_known(docs, prototypes)
    assert kept.columns == docs.columns and kept.count() == sum(r.p.lang != "und" for r in found)


def test_nothing_learned(spark):
    assert language.learn(empty(spark)) == {}
    found = documents(spark).select(language.predict(F.col("text"), {}, spark).alias("p")).distinct().collect()
    assert [(r.p.lang, r.p.score) for r in found] == [("und", 0.0)]
    assert empty(spark).select(language.predict(F.col("text"), {}, spark)).count() == 0
