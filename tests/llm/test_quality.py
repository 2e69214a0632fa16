import itertools

import numpy as np
from pyspark.sql import functions as F

from fabtrace.llm import quality
from fabtrace.llm.common import held_out
from tests.llm.data import documents, empty


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(2)
    sizes, moves = np.array([3, 1, 5, 2]), rng.normal(size=(2, 2))
    scores = rng.normal(size=sizes.sum())
    got, pairs = quality.marginals(scores, sizes, moves)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, good, moved = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            steps = list(itertools.pairwise(y))
            p = np.exp(sum(s for s, v in zip(scores[at : at + n], y, strict=True) if v) + sum(moves[s] for s in steps))
            total += p
            good += p * np.array(y)
            for s in steps:
                moved[s] += p
        want += list(good / total)
        want_pairs += moved / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["One line.\n\nSHOUT!! SHOUT!!\n", "", "\n\n", "a a a a", "x | y 1 2\nOne line."]
    x, doc, size = quality.line_features(texts)
    for i, t in enumerate(texts):
        own, _, own_size = quality.line_features([t])
        assert np.allclose(x[doc == i], own) and (size[doc == i] == own_size).all()
    assert list(np.bincount(doc, minlength=5)) == [2, 0, 0, 1, 2]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    field = quality.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = docs.where(held_out(F.col("doc_id"))).join(labels, "doc_id")
    found = rows.select("quality", quality.predict(F.col("text"), field, spark).alias("score")).collect()
    assert np.mean([(r.score >= quality.GOOD_FROM) == (r.quality == 1) for r in found]) > 0.95
    awkward = documents(spark).select("text", quality.predict(F.col("text"), field, spark).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in awkward)
    assert all(abs(r.s - field.prior) < 1e-12 for r in awkward if not (r.text or ""))


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    field = quality.learn(documents(spark), labels)
    assert field.prior == 0.5
    assert empty(spark).select(quality.predict(F.col("text"), field, spark)).count() == 0
