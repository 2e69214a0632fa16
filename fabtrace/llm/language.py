"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, fixed by a hash of its code point. A letter
trigram is bound from its letters' vectors, each rotated by its place and multiplied with
the others; a text is the bundle (sum) of its trigrams, and a language the bundle of all its
texts. A text gets the language whose bundle has the largest cosine with its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fabtrace.llm.common import Batches, gather, in_batches

DIMENSIONS = 1024
UNKNOWN = "und"
# More languages than this make the table of prototypes too large to send around.
MOST_LANGUAGES = 4096
# Longer texts are counted piece by piece, with two letters carried from one to the next, so that
# only memory depends on it.
LONGEST_PIECE = 1 << 18
GRAMS_AT_ONCE = 4096
# Texts times trigrams in one table of counts; more are counted in halves.
MOST_COUNTS = 1 << 23
# A bound for ``keep_known`` to reject texts by their best cosine: three times the standard
# deviation of the cosine of unrelated vectors. A text in a language that was not learned, or of
# random letters, seldom reaches it; of learned languages only texts of a word or two don't.
LEAST_SCORE = 3 / DIMENSIONS**0.5

PREDICTION = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(code_points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed random vector of +1 and -1 for each code point (0 stands for a blank)."""
    words = np.arange(dimensions // 64, dtype=np.uint64)
    x = code_points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (
        words + np.uint64(1)
    ) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundle of every text's trigrams; zero where a text has no letter.

    Letters are lower-cased; everything between two words is one blank, and so are a text's ends.
    """
    out = np.zeros((len(texts), dimensions), np.float32)
    short = [i for i, t in enumerate(texts) if len(t) <= LONGEST_PIECE]
    done = 0
    for batch in in_batches(texts[i] for i in short):
        classes, owner = _joined([t.lower() for t in batch])
        out[short[done : done + len(batch)]] = _bundled(classes, owner, len(batch), dimensions)
        done += len(batch)
    for i, text in enumerate(texts):
        if len(text) > LONGEST_PIECE:
            for classes in _pieces(text.lower()):
                out[i] += _bundled(classes, np.zeros(len(classes), np.int64), 1, dimensions)[0]
    return out


def _joined(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as code points and blanks as 0, of all texts one after the other, and whose they are."""
    points = np.frombuffer(("\0".join(["", *lowered, ""])).encode("utf-32-le"), np.uint32)
    text_of = np.repeat(np.arange(-1, len(lowered)), [1, *[len(t) + 1 for t in lowered]])
    letter = _letters()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first blank after a word
    return np.where(letter, points, 0)[keep], text_of[keep]


def _pieces(lowered: str) -> Iterator[np.ndarray]:
    """The same of one text, in pieces that begin with the last two classes of the one before."""
    carried = np.zeros(1, np.uint32)
    for at in range(0, len(lowered), LONGEST_PIECE):
        piece = lowered[at : at + LONGEST_PIECE]
        if at + LONGEST_PIECE >= len(lowered):
            piece += "\0"
        points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        letter = _letters()[points]
        keep = letter.copy()
        keep[0] |= carried[-1] != 0
        keep[1:] |= letter[:-1]
        classes = np.concatenate([carried, np.where(letter, points, 0)[keep]])
        yield classes
        carried = classes[-2:]


def bundle_of_all(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of the bundles of all texts."""
    total = np.zeros(dimensions)
    for batch in in_batches(t for t in texts if len(t) <= LONGEST_PIECE):
        total += _bundled(*_joined([t.lower() for t in batch]), 1, dimensions)[0]
    for text in texts:
        if len(text) > LONGEST_PIECE:
            total += bundles([text], dimensions)[0]
    return total


def _bundled(classes: np.ndarray, owner: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The bundles of n texts from their classes, of all together if n is 1.

    A text begins with the blank that ends the one before.
    """
    present = np.zeros(0x110000, bool)
    present[classes] = True
    present[0] = True
    letters = np.flatnonzero(present)
    rank = np.zeros(0x110000, np.int64)
    rank[letters] = np.arange(len(letters))
    c, size = rank[classes], len(letters)
    inside = owner[1:-1] == owner[2:]  # not across two texts
    grams = (c[:-2] * size * size + c[1:-1] * size + c[2:])[inside]
    return _weighted(grams, owner[2:][inside] if n > 1 else np.zeros(len(grams), np.int64), n, letters, dimensions)


def _weighted(grams: np.ndarray, owner: np.ndarray, n: int, letters: np.ndarray, dimensions: int) -> np.ndarray:
    """The sum of the vectors of each text's trigrams; ``owner`` does not fall."""
    vectors = np.zeros((n, dimensions), np.float32)
    if not len(grams):
        return vectors
    size = len(letters)
    if size**3 <= 1 << 22:
        ids = np.flatnonzero(np.bincount(grams, minlength=size**3))
        place = np.zeros(size**3, np.int64)
        place[ids] = np.arange(len(ids))
        place = place[grams]
    else:
        ids, place = np.unique(grams, return_inverse=True)
    if n > 1 and n * len(ids) > MOST_COUNTS:
        half, at = n // 2, np.searchsorted(owner, n // 2)
        vectors[:half] = _weighted(grams[:at], owner[:at], half, letters, dimensions)
        vectors[half:] = _weighted(grams[at:], owner[at:] - half, n - half, letters, dimensions)
        return vectors
    counts = np.bincount(owner * len(ids) + place, minlength=n * len(ids)).reshape(n, len(ids)).astype(np.float32)
    base = letter_vectors(letters, dimensions)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    for at in range(0, len(ids), GRAMS_AT_ONCE):
        g = ids[at : at + GRAMS_AT_ONCE]
        bound = first[g // (size * size)] * second[g // size % size] * base[g % size]
        vectors += counts[:, at : at + GRAMS_AT_ONCE] @ bound.astype(np.float32)
    return vectors


def learn(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, np.ndarray]:
    """The bundle of each language, from all given rows with text and language."""
    rows = labelled.select(
        F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not names:
        return {}
    place = {n: i for i, n in enumerate(names)}

    def fill(batches: Batches) -> np.ndarray:
        total = np.zeros((len(names), DIMENSIONS))
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            by_lang: dict[str, list[str]] = {}
            for t, n in zip(texts, langs, strict=True):
                by_lang.setdefault(n, []).append(t)
            for n, own in by_lang.items():
                total[place[n]] += bundle_of_all(own)
        return total

    found = gather(rows, fill, DIMENSIONS, np.float64, len(names))
    return {n: found[i] for n, i in place.items() if found[i].any()}


def predict(text: Column, prototypes: dict[str, np.ndarray], spark) -> Column:
    """A struct of lang and score (the cosine, at least 0) for a text.

    Null, empty and other texts without a letter get ``und`` and 0, and so does every text if
    no language was learned. Equal cosines go to the first language by name.
    """
    names = sorted(prototypes)
    table = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names], np.float32)
    shared = spark.sparkContext.broadcast((names, table))

    @F.arrow_udf(PREDICTION)
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, table = shared.value
        for texts in batches:
            langs, scores = [], []
            for part in in_batches(t or "" for t in texts.to_pylist()):
                vectors = bundles(part)
                length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
                if not names:
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                cosine = (vectors @ table.T) / np.maximum(length, 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(part)), best], 0, 1)
                langs += [names[b] if n else UNKNOWN for b, n in zip(best, length, strict=True)]
                scores += np.where(length > 0, score, 0).astype(float).tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"]
            )

    return identify(text)


def keep_known(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text_column: str = "text", least: float = 0.0
) -> DataFrame:
    """The documents with a letter whose score is ``least`` or more, with their own columns."""
    found = predict(F.col(f"`{text_column}`"), prototypes, docs.sparkSession)
    return docs.where((found.lang != UNKNOWN) & (found.score >= least))
