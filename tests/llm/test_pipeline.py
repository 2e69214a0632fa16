import os
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fabtrace.llm import decontaminate, language
from fabtrace.llm.common import held_out
from fabtrace.sources.scratch import new_path
from tests.llm.data import documents
from tests.llm.test_decontaminate import brute
from tests.llm.test_near import brute_classes


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, outputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "test-stage")
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        outputs.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in outputs[:4]]
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}

    assert texts[0].items() <= source.items()
    known = language.learn(spark.read.parquet(f"{small}/documents.parquet").where(~held_out(F.col("doc_id"))))
    table = np.array([v / np.linalg.norm(v) for v in known.values()])
    own = language.bundles([t or "" for t in source.values()])
    length = np.linalg.norm(own, axis=1)
    score = (own @ table.T / np.maximum(length, 1e-9)[:, None]).max(axis=1)
    sure = {k: s for k, s in zip(source, score, strict=True) if abs(s - language.LEAST_SCORE) > 1e-4}
    assert sure.keys() & texts[0].keys() == {k for k, s in sure.items() if s > language.LEAST_SCORE}
    last = {}
    for k, t in sorted(texts[0].items()):
        last[t.encode().lower()] = k
    assert texts[1].keys() == set(last.values())
    rows = sorted(texts[1].items())
    assert texts[2].keys() == {min(rows[i][0] for i in c) for c in brute_classes(rows)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    maybe = {w for _, t in items for w in decontaminate.words(t.encode())}
    clean = set()
    for k, t in texts[2].items():
        suspect = len(maybe & set(decontaminate.words(t.encode()))) > 12
        if not (suspect and brute(items, t)[3]):
            clean.add(k)
    assert texts[3].keys() == clean
    tokens = outputs[4].collect()
    assert {r.doc_id for r in tokens} == clean
    assert all(r.n_tokens * 4 == len(r.ids) for r in tokens)


def test_texts_in_no_known_language_go(spark, small):
    rng = random.Random(5)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(500)), "Этого языка здесь нет. " * 9, "1 2 3"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(junk)]
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), small)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {-1, -2, -3} and len(ids) > docs.count() * 0.98


def test_tables_of_earlier_stages_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = new_path(spark, "test-stage")
    corpus_pipeline.drop_copies(spark, docs, small).write.parquet(path)
    before = list(corpus_pipeline._left)
    corpus_pipeline.drop_contaminated(spark, spark.read.parquet(path), small)
    assert before and not any(os.path.exists(p.removeprefix("file:")) for p in before)


def test_awkward_rows_pass_every_stage(spark, small):
    awkward = documents(spark).withColumnRenamed("left", "source").withColumn("lang", F.lit(None).cast("string"))
    known = spark.read.parquet(f"{small}/documents.parquet").where("doc_id >= 100")
    kept = awkward.unionByName(known.drop("n_chars"), allowMissingColumns=True)
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, "test-stage")
        stage(spark, kept, small).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids) > 20 and ids & set(range(12))
    assert corpus_pipeline.STAGES[-1][1](spark, kept, small).count() == len(ids)
