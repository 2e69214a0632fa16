"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score comes from features of the line and its neighbours, and
neighbouring labels from a table of transitions. Forward and backward passes give each line's
probability of being good; their mean weighted by line length is the document's quality. The
field is fitted to documents whose lines all have the document's label.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fabtrace.llm.common import BATCH_CHARS, Batches, in_batches

# The field is fitted to so many labelled documents, those with the smallest hash of their id,
# and to so many consecutive lines of each, from a place given by that hash.
SAMPLE_DOCUMENTS = 6000
SAMPLE_LINES = 64
STEPS, RATE, DECAY = 300, 0.1, 1e-4
GOOD_FROM = 0.3

_OTHER, _LOWER, _UPPER, _DIGIT, _BLANK, _MARK = range(6)
N_OWN, N_FEATURES = 17, 29


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""

    def kind(c: str) -> int:
        if c.isspace():
            return _BLANK
        if c.isalpha():
            return _UPPER if c.isupper() else _LOWER
        return _DIGIT if c.isdigit() else _MARK if c in ".,;:?!'\"-()" else _OTHER

    return np.fromiter((kind(chr(i)) for i in range(0x110000)), np.uint8, 0x110000)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, text number and length of every line that isn't empty."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    full = ends > starts
    starts, ends = starts[full], ends[full]
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts
    kinds = _kinds()[points]
    line = np.zeros(len(points), np.int64)
    line[starts] = 1
    line = np.cumsum(line) - 1

    blank = kinds == _BLANK

    def per_line(mask: np.ndarray) -> np.ndarray:
        # Line feeds between the lines are blanks, and blanks are never asked for.
        return np.add.reduceat(mask.astype(np.int64), starts)

    lower, upper, digit = (per_line(kinds == k) for k in (_LOWER, _UPPER, _DIGIT))
    other, mark = per_line(kinds == _OTHER), per_line(kinds == _MARK)

    word_start = ~blank
    word_start[1:] &= blank[:-1]
    at = np.flatnonzero(word_start)
    words = per_line(word_start)
    if len(at):
        number = np.cumsum(word_start) - 1
        place = np.arange(len(points)) - at[np.maximum(number, 0)]
        mix = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        mix *= (place.astype(np.uint64) * np.uint64(2) + np.uint64(0xD1B54A32D192ED03))
        mix[blank] = 0
        hashes, word_line = np.add.reduceat(mix, at), line[at]
        again = np.zeros(len(at), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
        repeats = np.bincount(word_line[again], minlength=len(starts))
        keys = hashes ^ (word_line.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        distinct = np.bincount(word_line[np.unique(keys, return_index=True)[1]], minlength=len(starts))
        whole = np.bincount(word_line, (hashes >> np.uint64(12)).astype(np.float64), len(starts))
    else:
        repeats = distinct = np.zeros(len(starts), np.int64)
        whole = np.zeros(len(starts))

    some = np.maximum(words, 1)
    up = upper / np.maximum(lower + upper, 1)
    odd, rep, mean = other / size, repeats / some, (size - words + 1) / some
    ending = np.isin(points[ends - 1], [33, 46, 63])
    own = [
        np.log1p(size) / 6, up, odd, digit / size, mark / size, np.minimum(mean / 10, 3), rep,
        distinct / some, ending, up > 0.5, odd > 0.02, odd > 0.1, rep > 0.2, rep > 0.5, mean > 15,
        words < 3, digit / size > 0.3,
    ]
    doc = text_of[starts]
    x = np.zeros((len(starts), N_FEATURES), np.float32)
    x[:, :N_OWN] = np.stack(own, axis=1)
    follows = np.zeros(len(starts), bool)
    follows[1:] = doc[1:] == doc[:-1]
    shared = x[:, [0, 1, 2, 6]]
    x[1:, N_OWN : N_OWN + 4] = shared[:-1] * follows[1:, None]
    x[:-1, N_OWN + 4 : N_OWN + 8] = shared[1:] * follows[1:, None]
    x[:, 25] = follows
    x[:-1, 26] = follows[1:]
    x[1:, 27] = follows[1:] & (whole[1:] == whole[:-1])
    x[:, 28] = 1
    return x, doc, size


@dataclass(frozen=True)
class Field:
    """Weights of the features, of the four transitions, and the share of good documents."""

    weights: np.ndarray
    moves: np.ndarray
    prior: float


def _chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains from the longest on: their first lines and lengths."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    return first[order], sizes[order]


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each transition.

    ``scores`` are the lines' log odds for good, chain after chain; ``moves`` the log weights
    of the transitions (from, to).
    """
    first, length = _chains(sizes)
    steps = int(length.max(initial=0))
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]
    emit = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], axis=1)
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.exp(moves)
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    pairs = np.zeros((2, 2))
    for t in range(steps):
        at = first[: live[t]] + t
        a = emit[at] if t == 0 else (forward[at - 1] @ move) * emit[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 1, 0, -1):
        at = first[: live[t]] + t
        ahead = backward[at] * emit[at]
        b = ahead @ move.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = forward[at - 1][:, :, None] * move * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    good = forward * backward
    return good[:, 1] / good.sum(axis=1), pairs


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood by gradient ascent with adaptive steps; a label per chain."""
    if not len(labels):
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.5)
    x = x.astype(np.float64)
    y = np.repeat(labels, sizes).astype(np.float64)
    stay = np.maximum(sizes - 1, 0)
    seen = np.diag([stay[labels == 0].sum(), stay[labels == 1].sum()]).astype(float)
    value = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        weights, moves = value[:-4], value[-4:].reshape(2, 2)
        good, pairs = marginals(x @ weights, sizes, moves)
        slope = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(y) - DECAY * value
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        value = value + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Field(value[:-4], value[-4:].reshape(2, 2), float(labels.mean()))


def score(texts: list[str], field: Field) -> np.ndarray:
    """Quality of every text; the share of good documents for one without a line."""
    x, doc, size = line_features(texts)
    sizes = np.bincount(doc, minlength=len(texts))
    good, _ = marginals(x @ field.weights, sizes[sizes > 0], field.moves)
    total = np.bincount(doc, good * size, len(texts))
    length = np.bincount(doc, size, len(texts))
    return np.where(length > 0, total / np.maximum(length, 1), field.prior).clip(0, 1)


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality"
) -> Field:
    """Fit the field to a bounded sample of labelled documents.

    Rows with a null id, text or label are left out; of several labels of one id the largest
    counts. Only the sample's line features come to the driver.
    """
    key = F.xxhash64("id")
    chosen = (
        labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(key, "id")
        .limit(SAMPLE_DOCUMENTS)
    )
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    rows = rows.where("text IS NOT NULL").join(F.broadcast(chosen), "id")

    def lines(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = line_features([text])[0]
                start = key % max(1, len(x) - SAMPLE_LINES + 1)
                out.append(x[start : start + SAMPLE_LINES].tobytes())
            yield pa.record_batch(
                {"key": batch.column("key"), "label": batch.column("label"), "x": pa.array(out, pa.binary())}
            )

    sample = (
        rows.select(key.alias("key"), "label", "text")
        .mapInArrow(lines, "key long, label int, x binary")
        .orderBy("key", F.crc32("x"))
        .limit(SAMPLE_DOCUMENTS)
        .toLocalIterator()
    )
    found = [(r.label, bytes(r.x)) for r in sample if r.x]
    x = np.frombuffer(b"".join(f[1] for f in found), np.float32).reshape(-1, N_FEATURES)
    sizes = np.array([len(f[1]) // (4 * N_FEATURES) for f in found], np.int64)
    return fit(x, sizes, np.array([f[0] for f in found], np.int64))


def predict(text: Column, field: Field, spark) -> Column:
    """Quality from 0 to 1; null counts as empty."""
    shared = spark.sparkContext.broadcast(field)

    @F.arrow_udf(DoubleType())
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if not len(texts):
                yield pa.array([], pa.float64())
            for part in in_batches((t or "" for t in texts.to_pylist()), 2 * BATCH_CHARS):
                yield pa.array(score(part, shared.value))

    return quality(text)
