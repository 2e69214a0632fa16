"""Byte-level BPE encoding and decoding.

A text is cut at white space; what stands between is cut into pieces by the tokenizer's
pattern. A piece starts as one symbol per byte in a doubly linked list. A priority queue
holds the ranks of all adjacent pairs that merge; the lowest rank is merged first, and an
entry whose symbols have changed since it was queued is skipped. Decoding concatenates the
vocabulary's byte strings.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from fabtrace.llm.common import in_batches, values

# Results kept by a task for words it meets again. Only speed depends on them.
WORDS_KEPT = 450_000
PIECES_KEPT = 300_000
LONGEST_KEPT = 48
# Stands for the rank of a pair that never merges.
_NO_MERGE = 1 << 30

# The byte-level pattern and what it takes for white space.
_BLANK = "".join(
    map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+"
    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_WORDS = re.compile(rf"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
# Words that need no search for their pieces: plain letters and then plain marks, of which none
# begins a contraction.
_SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)\]}\"]*)").fullmatch
# A blank after other white space: such a text isn't cut at every blank.
_RUN = re.compile(r"\s ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable Latin-1 letters stand for themselves, the others for those from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Computes what it doesn't hold."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(key) <= LONGEST_KEPT and len(self) < self.most:
            self[key] = value
        return value


class Bpe:
    """A byte-level tokenizer read from the text of its JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if (
            model["type"] != "BPE"
            or cut["type"] != "ByteLevel"
            or cut["add_prefix_space"]
            or not cut["use_regex"]
            or spec.get("normalizer")
            or model.get("ignore_merges")
        ):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocabulary = model["vocab"]
        self.byte_ids = [vocabulary[c] for c in letters]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
        for token, i in (vocabulary | added).items():
            self.table[i] = bytes(byte_of[c] for c in token)
        ranks: list[dict[int, int]] = [{} for _ in self.table]  # by first symbol, then by the second
        self.merged: list[int] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ranks[vocabulary[a]][vocabulary[b]] = len(self.merged)
            self.merged.append(vocabulary[a + b])
        self.rank_after = [own.get for own in ranks]
        self.first_ranks = [[ranks[a].get(b, _NO_MERGE) for b in self.byte_ids] for a in self.byte_ids]
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, names))) if names else None
        self.pieces = _Known(self._piece, PIECES_KEPT)
        self.words = _Known(self._word, WORDS_KEPT)
        self.after_blank = _Known(lambda w: self._word(" " + w), WORDS_KEPT)

    def merge(self, piece: bytes) -> list[int]:
        """Apply the merges to the symbols of one piece, lowest rank first, then leftmost.

        ``rank[i]`` is that of the pair that begins at symbol i now. An entry of the queue with
        another one is stale: a symbol was merged away, or has become another one.
        """
        ids = [*map(self.byte_ids.__getitem__, piece)]
        rows = self.first_ranks
        rank = [rows[a][b] for a, b in zip(piece, piece[1:], strict=False)]
        queue = [(r << 32) + i for i, r in enumerate(rank) if r != _NO_MERGE]
        if not queue:
            return ids
        n, merged, rank_after, pop, push = len(ids), self.merged, self.rank_after, heapq.heappop, heapq.heappush
        heapq.heapify(queue)
        rank.append(_NO_MERGE)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        while queue:
            top = pop(queue)
            i = top & 0xFFFFFFFF
            if rank[i] != top >> 32:
                continue
            j = after[i]
            ids[i] = new = merged[top >> 32]
            ids[j], rank[j] = -1, _NO_MERGE
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                rank[i] = r = rank_after[new](ids[j], _NO_MERGE)
                if r != _NO_MERGE:
                    push(queue, (r << 32) + i)
            else:
                rank[i] = _NO_MERGE
            j = before[i]
            if j >= 0:
                rank[j] = r = rank_after[ids[j]](new, _NO_MERGE)
                if r != _NO_MERGE:
                    push(queue, (r << 32) + j)
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        simple = _SIMPLE(word)
        if simple:  # letters, and what follows them: two pieces
            letters, rest = simple.groups()
            return self.pieces[letters] + self.pieces[rest] if rest else self.pieces[letters]
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens. Pieces never reach from a letter into white space."""
        if _RUN.search(text):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))
        words = text.split(" ")
        first = self.words[words[0]] if words[0] else b""
        return first + b"".join(map(self.after_blank.__getitem__, words[1:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.specials or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += [self._plain(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def forget(self, everything: bool = False) -> None:
        """Start anew with the words kept, where no more can be or with all of them."""
        for known in (self.words, self.after_blank, self.pieces):
            if everything or len(known) >= known.most:
                known.clear()

    def decode(self, ids: bytes) -> str:
        parts = map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


_MADE: dict[int, Bpe] = {}


def _made(source: Broadcast) -> Bpe:
    """The tokenizer of this Python worker."""
    text = source.value
    key = hash(text)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Bpe(text)
    return _MADE[key]


def load(spark, path: str) -> Broadcast:
    """A tokenizer file, sent to all tasks; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    Bpe(source)
    return spark.sparkContext.broadcast(source)


def encode(text: Column, tokenizer: Broadcast) -> Column:
    """Token ids of a text as a binary of little-endian unsigned 32-bit integers.

    Null counts as empty; an empty text has no ids. A task leaves no words behind: Spark keeps
    its workers, and would hold the words of each of them while others work.
    """

    @F.arrow_udf(BinaryType())
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _made(tokenizer)
        try:
            for texts in batches:
                if not len(texts):
                    yield pa.array([], pa.binary())
                for part in in_batches((t or "" for t in values(texts)), 1 << 20):
                    yield pa.array([bpe.encode(t) for t in part], pa.binary())
                    bpe.forget()
        finally:
            bpe.forget(everything=True)

    return ids(text)


def decode(ids: Column, tokenizer: Broadcast) -> Column:
    """The text of token ids; null stays null, bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf(StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _made(tokenizer)
        for batch in batches:
            for at in range(0, max(len(batch), 1), 256):
                part = batch.slice(at, 256).to_pylist()
                yield pa.array([None if i is None else bpe.decode(i) for i in part], pa.string())

    return text(ids)
