"""A corpus from raw documents to token ids, stage by stage.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what it returns as Parquet in
the shared folder and reads it back as the next stage's documents. So when a stage begins,
the tables that earlier ones stored on the way are needed no more and go. All stages but the
last return the columns of ``documents``. SQL can't express the stages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabtrace.llm import bpe, decontaminate, exact, language, near
from fabtrace.llm.common import drop, held_out, recorded
from fabtrace.sources.scratch import new_path
from fabtrace.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage that first drops the tables of the stages before, whose results are saved."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            drop(spark, _left.pop())
        with recorded() as paths:
            result = f(spark, docs, sf_dir)
        _left.extend(paths)
        return result

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those like none of them, or without a letter, go.
    Languages are learned from the documents of this stage that aren't held out and name theirs."""
    prototypes = language.learn(docs.where(~held_out(F.col("doc_id"))))
    return language.keep_known(docs, prototypes, least=language.LEAST_SCORE)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z, the document with the largest id."""
    return exact.deduplicate(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id."""
    return near.keep_one(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth of the words."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers), and the
    digests of the ids and of the text decoded from them."""
    tokenizer = bpe.load(spark, public_tokenizers.path(TOKENIZER))
    encoded = docs.select("doc_id", "lang", "source", bpe.encode(F.col("text"), tokenizer).alias("ids"))
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), tokenizer).cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = new_path(spark, f"stage-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
