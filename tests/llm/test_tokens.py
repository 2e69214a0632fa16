import heapq
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fabtrace.llm import tokens
from tests.llm.data import ROWS, documents


def huffman_bits(counts):
    """Bits of the best code without a limit."""
    heap, total = sorted(c for c in counts if c), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@given(st.lists(st.integers(0, 50), min_size=2, max_size=60))
@settings(max_examples=60, deadline=None)
def test_lengths_are_best_without_a_limit_in_the_way(counts):
    counts = np.array(counts)
    lengths = tokens.code_lengths(counts, 24)
    assert ((lengths > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert (lengths * counts).sum() == huffman_bits(counts.tolist())
        assert (2.0 ** -lengths[lengths > 0]).sum() == 1


def test_limit_is_kept():
    counts = 2 ** np.arange(40)
    lengths = tokens.code_lengths(counts, 6)
    assert lengths.max() == 6 and (2.0**-lengths).sum() == 1
    with pytest.raises(ValueError):
        tokens.code_lengths(counts, 5)


@pytest.mark.parametrize("block", [1, 7, 512])
def test_bits_round_trip(monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    rng = np.random.default_rng(block)
    counts = (rng.pareto(0.8, 700) * 9 + 1).astype(int)
    lengths = tokens.code_lengths(counts)
    codes, table = tokens.canonical(lengths)
    sizes = np.array([0, 1, 600, 0, 513, 512, 2, 0])
    ids = rng.choice(700, sizes.sum(), p=counts / counts.sum())
    bits, checkpoints = tokens.pack(ids, sizes, codes, lengths)
    assert (tokens.unpack(bits, checkpoints, sizes, table) == ids).all()


def test_one_id_and_none():
    for counts, ids in (([0, 9, 0], [1] * 9), ([0, 0, 0], [])):
        lengths = tokens.code_lengths(np.array(counts))
        codes, table = tokens.canonical(lengths)
        sizes = np.array([len(ids)])
        bits, checkpoints = tokens.pack(np.array(ids, int), sizes, codes, lengths)
        assert tokens.unpack(bits, checkpoints, sizes, table).tolist() == ids


def test_files_hold_what_the_library_says(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, tokenizer = Tokenizer.from_file(path), tokens.load(spark, path)
    rows = documents(spark).select(F.col("doc_id").alias("id"), tokens.tokenize(F.col("text"), tokenizer, 1).alias("ids"))
    target = f"{tmp_path}/{uuid.uuid4().hex}"
    tokens.write(rows, target, 49_408)
    got = tokens.read(spark, target).collect()
    want = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ROWS]
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1]))
    assert sorted(((r.id, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before and r.n_tokens * 4 == len(r.ids)
        before += r.n_tokens
    ordered = [-1 if r.id is None else r.id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered)


def test_words_as_the_library_has_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        words = tokens.Words(f.read())
    library = Tokenizer.from_file(path)
    rng = random.Random(7)
    bits = [
        " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2028", "a", "The", "É", "é", "e\u0301", "\u0301", "ß", "ẞ", "İ", "ſ",
        "Σ", "ς", "µ", "ª", "×", "÷", "ÿ", "Ÿ", "中文", "1", "²", "'s", "'LL", "'", "!", ".", ",", "..", ").", "-",
        "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\U0001f600", "word", "WORD",
    ]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode([text], b"")[0], "<u4").tolist() == ids, text


def test_forgetting_words_changes_nothing(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = tokens.Words(f.read())
    texts = [t or "" for _, t in ROWS]
    want = words.encode(texts, b"")
    monkeypatch.setattr(tokens, "WORDS_KEPT", 0)
    assert [words.encode([t], b"")[0] for t in texts] == want


def test_arrays_of_words(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        words = tokens.Words(f.read())
    library, asked, by_plain = Tokenizer.from_file(path), [], words._by_plain
    monkeypatch.setattr(words, "_by_plain", lambda stems: asked.extend(stems) or by_plain(stems))
    texts = ["One two, ONE. two", "", "Éa!! one$$$ d'accord l'an 12 a.b", "x\ny  two#%", *[t or "" for _, t in ROWS]] * 2
    array = pa.array(["not asked", *texts])[1:]
    found = [np.frombuffer(b, "<u4").tolist() for b in words.encode_array(array, np.uint32(1).tobytes()).to_pylist()]
    assert found == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    # Every plain word is asked for once, whatever its case and the marks behind it.
    assert len(asked) == len(set(asked)) and {"one", "two", "éa"} <= set(asked) and "asked" not in asked
    assert words.encode_array(pa.array([], pa.string()), b"").to_pylist() == []
    # The same if the vocabulary doesn't tell where a word ends.
    words.known.clear()
    words.last[:] = False
    assert [np.frombuffer(b, "<u4").tolist() for b in words.encode(texts, np.uint32(1).tobytes())] == found


def test_empty_files_and_foreign_ids(spark, tmp_path):
    nothing = spark.createDataFrame([], "id long, ids binary")
    tokens.write(nothing, f"{tmp_path}/none", 10)
    assert tokens.read(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="not below 10"):
        tokens.write(spark.createDataFrame([(1, np.uint32(10).tobytes())], "id long, ids binary"), f"{tmp_path}/bad", 10)


def test_known_words_are_encoded_once():
    known, asked = tokens.Known(), []

    def encode(words):
        asked.extend(words)
        return np.array([len(w) for w in words for _ in w], "<u4"), np.array([len(w) for w in words])

    for words in (["a", "ccc", ""], [], ["", "bb", "a"], ["ccc"]):
        at = known.numbers(pa.array(["zz", *words], pa.string())[1:], encode)
        ends = np.cumsum(known.sizes)
        assert [known.ids[ends[i] - known.sizes[i] : ends[i]].tolist() for i in at] == [[len(w)] * len(w) for w in words]
    assert asked == ["a", "ccc", "", "bb"] and len(known) == 4
    known.clear()
    assert len(known) == 0 and known.numbers(pa.array(["bb"]), encode).tolist() == [0]
