"""Word shingles as 64-bit hashes, made for many texts at once."""

from __future__ import annotations

import numpy as np

from fabtrace.llm.decontaminate import _FOLD as FOLD

SHINGLE = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(joined: bytes, fold: bytes = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of the text.

    Words are lower-cased (A-Z only) and end at ASCII characters that are no letter or digit,
    or at what else ``fold`` makes a blank.
    """
    raw = np.frombuffer(joined.translate(fold), np.uint8)
    blank = raw == 32
    start = ~blank
    start[1:] &= blank[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), at
    place = np.arange(len(raw), dtype=np.int64)
    place -= at[np.maximum(np.cumsum(start) - 1, 0)]
    value = raw.astype(np.uint64)
    value *= place.astype(np.uint64) * _GOLDEN + np.uint64(0xD1B54A32D192ED03)
    value ^= value >> np.uint64(32)
    value[blank] = 0
    return mixed(np.add.reduceat(value, at)), at


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, one after the other, and the number of words of each."""
    hashes, at = hashed_words(b" ".join([*texts, b""]))
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(at, ends))


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of SHINGLE words, and the text of each; a shorter text is one shingle."""
    first = np.cumsum(counts) - counts
    total = np.zeros(len(words), np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(first + counts, counts) - np.arange(len(words))  # words from here to the end
    for k in range(SHINGLE):
        factor = mixed(np.array([k + 1], np.uint64) * _GOLDEN)[0] | np.uint64(1)
        here = left > k
        moved = np.zeros(len(words), np.uint64)
        moved[: max(0, len(words) - k)] = words[k:]
        total += np.where(here, moved * factor, np.uint64(0))
    whole = left >= SHINGLE
    whole[first[counts > 0]] = True
    return mixed(total[whole]), text[whole]


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their text and how often they occur in it."""
    if not len(hashes):
        return hashes, text, np.zeros(0, np.int64)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))
