import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fabtrace.llm import bpe
from tests.llm.data import ROWS, documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [
    " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "᠎", "​", " ", "　", "a", "the",
    "é", "é", "ß", "中文", "١", "²", "Ⅷ", "'s", "'ll", "'", "!", "?", "<|endoftext|>", "<|endoftext",
    "\U0001f600", "1", "23", "\x00", "﻿", "ǅ", "ª", "A", "\U00010400",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def test_as_the_library_does(library, own):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_one_very_long_word(library, own):
    text = "abcdefgh" * 5000 + "z" * 3000
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text(library, own):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(8)]
        want = library.decode(ids, skip_special_tokens=False)
        assert own.decode(np.array(ids, "<u4").tobytes()) == want


def test_forgetting_changes_nothing(own):
    before = [own.encode(t or "") for _, t in ROWS]
    for known in (own.words, own.after_blank, own.pieces):
        known.most = 0
    own.forget()
    assert [own.encode(t or "") for _, t in ROWS] == before


def test_tasks_leave_no_words_behind(spark):
    tokenizer = bpe.load(spark, PATH)
    docs = spark.range(0, 64, 1, 64).select(F.concat(F.lit("some words of "), "id").alias("text"))
    docs.select(bpe.encode(F.col("text"), tokenizer)).write.format("noop").mode("overwrite").save()

    def held(batches):
        kept = sum(len(k) for b in bpe._MADE.values() for k in (b.words, b.after_blank, b.pieces))
        yield pa.record_batch({"made": pa.array([len(bpe._MADE)]), "kept": pa.array([kept])})

    rows = spark.range(0, 64, 1, 64).mapInArrow(held, "made long, kept long").collect()
    assert any(r.made for r in rows) and not any(r.kept for r in rows)


def test_awkward_rows(spark, library):
    tokenizer = bpe.load(spark, PATH)
    docs = documents(spark).select("text", bpe.encode(F.col("text"), tokenizer).alias("ids"))
    rows = docs.select("text", "ids", bpe.decode(F.col("ids"), tokenizer).alias("back")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.back == (r.text or "")
    none = empty(spark).select(bpe.encode(F.col("text"), tokenizer).alias("ids"))
    assert none.select(bpe.decode(F.col("ids"), tokenizer)).count() == 0


def test_other_kinds_of_tokenizer_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    with pytest.raises((ValueError, KeyError)):
        bpe.Bpe(source)
