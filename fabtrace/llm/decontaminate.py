"""Benchmark passages in documents, found by Wu-Manber search over words.

A window is 13 consecutive words of a benchmark text, or all words of a shorter one. Windows
of one length are searched together: a table of word pairs says how far the search may skip,
pairs that end a window lead to a bucket of candidates, and these are compared word by word.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from fabtrace.llm.common import Batches, values
from fabtrace.sources.scratch import cut

WINDOW = 13
# Windows searched together. The tables of one block take about 1 KB per window; a larger
# benchmark is searched in several blocks, one after the other by the same tasks.
WINDOWS_PER_BLOCK = 100_000
# Bytes of text a task searches with the tables of one block before it builds the next.
SEARCHED_AT_ONCE = 1 << 24

FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("n_items", LongType()),
        StructField("items_sha256", StringType()),
        StructField("contaminated", BooleanType()),
    ]
)

# Lower-cases A-Z and makes every other ASCII character but 0-9 and a-z a blank. Bytes of
# characters beyond ASCII belong to words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Searcher:
    """Tables for the windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], length: int):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = self._key(window, end - 1)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[self._key(window, length - 1)].append((list(window), items))

    def _key(self, text, end: int):
        return text[end] if self.block == 1 else (text[end - 1], text[end])

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start of every occurrence, and the items that have the window."""
        m, far, get, buckets = self.length, self.far, self.shift.get, self.buckets
        single, end, n = self.block == 1, m - 1, len(text)
        while end < n:
            key = text[end] if single else (text[end - 1], text[end])
            skip = get(key, far)
            if skip:
                end += skip
                continue
            start = end - m + 1
            for window, items in buckets[key]:
                if window[0] == text[start] and window == text[start : end + 1]:
                    yield start, items
            end += 1


def build(rows: Iterable[tuple[str, str | None]]) -> list[Searcher]:
    """Searchers for (window, item) rows, the words of a window joined by blanks."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(dict)
    for window, item in rows:
        parts = tuple(window.encode().split(b" "))
        by_length[len(parts)].setdefault(parts, set()).add(item)
    return [Searcher(found, length) for length, found in sorted(by_length.items())]


def windows_of(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Each distinct (window, item); null texts and texts without words have none."""

    def cut_out(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str | None]] = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(text)
                for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                    out.append((b" ".join(w[i : i + WINDOW]).decode(), item))
            yield pa.record_batch(
                {"window": pa.array([o[0] for o in out], pa.string()), "item": pa.array([o[1] for o in out], pa.string())}
            )

    return (
        benchmark.select(
            F.col(f"`{id_column}`").cast("string").alias("item"),
            F.col(f"`{text_column}`").cast("binary").alias("text"),
        )
        .mapInArrow(cut_out, "window string, item string")
        .distinct()
    )


def blocks_of(windows: DataFrame, per_block: int = WINDOWS_PER_BLOCK) -> list[Broadcast]:
    """The windows in blocks of a bounded size, each sent to all tasks in compressed form."""
    spark = windows.sparkSession
    table = cut(windows)
    blocks = max(1, -(-table.count() // per_block))
    own = F.pmod(F.xxhash64("window"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    out = []
    for k in range(blocks):
        rows = [(r.window, r.item) for r in table.where(own == k).toLocalIterator()]
        out.append(spark.sparkContext.broadcast(zlib.compress(json.dumps(rows).encode())))
    return out


def _searchers(block: Broadcast) -> list[Searcher]:
    return build(json.loads(zlib.decompress(block.value)))


def _gathered(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    """Batches of texts, as many at once as SEARCHED_AT_ONCE allows."""
    own, size = [], 0
    for batch in batches:
        own.append(batch)
        size += batch.nbytes
        if size >= SEARCHED_AT_ONCE:
            yield own
            own, size = [], 0
    if own:
        yield own


class Hits:
    """The hit words of a text and the items they belong to."""

    __slots__ = ("hit", "items", "n_words")

    def __init__(self):
        self.n_words, self.hit, self.items = 0, None, set()

    def add(self, text: list[bytes], searchers: list[Searcher]) -> None:
        self.n_words = len(text)
        for s in searchers:
            for start, names in s.search(text):
                if self.hit is None:
                    self.hit = bytearray(len(text))
                self.hit[start : start + s.length] = b"\1" * s.length
                self.items |= names


def _summary(found: list[Hits]) -> pa.Array:
    """FOUND for the hits of each text."""
    n_words = [h.n_words for h in found]
    n_hit = [h.hit.count(1) if h.hit else 0 for h in found]
    names = [",".join(sorted(i or "" for i in h.items)) for h in found]
    return pa.StructArray.from_arrays(
        [
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(h.items) for h in found], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]),
            pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()),
        ],
        FOUND.fieldNames(),
    )


def find(text: Column, blocks: list[Broadcast]) -> Column:
    """What the windows find in a text: a struct of FOUND.

    A word is hit if any occurrence of a window covers it. A document is contaminated if it
    has hits and these are a twentieth of its words or more. Null has no words. Items without
    an id are one item, named by an empty string.
    """

    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = [_searchers(blocks[0])] if len(blocks) == 1 else None
        for together in _gathered(batches):
            found = [[Hits() for _ in range(len(batch))] for batch in together]
            for searchers in kept or map(_searchers, blocks):
                for batch, results in zip(together, found, strict=True):
                    # The words of one text at a time are held; they take ten times its bytes.
                    for text, hits in zip(values(batch), results, strict=True):
                        hits.add(words(text), searchers)
            yield from map(_summary, found)

    return search(text.cast("binary"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = find(F.col(f"`{text_column}`"), blocks_of(windows_of(benchmark)))
    return docs.where(~found.contaminated)
