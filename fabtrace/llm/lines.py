"""Lines similar to an earlier line, found by an exact set-similarity join, and removed.

A line is the set of its words. Two sets are similar if their Jaccard similarity is at least
LEAST. Words are ordered by rarity, the same way everywhere. Similar sets share a run of RUN
words, next to each other in both, among the first of both (prefix filter; see ``_runs``), their
sizes are close (length filter), and the run leaves about as many words before and behind it in
both (positional filter). A bitmap of all words rules out most of the pairs that pass, and the
Jaccard similarity of the rest is taken from the sets themselves. Sets that are equal are one in
the join. A run that only one set has makes no pair, so runs are looked for alone first. Similar
sets share up to SHARED such runs, so a set is sent only under runs that occur again, and under
all but some of these: the same prefix filter once more, on runs.

A line goes as soon as one earlier line is similar, so a set sends only its PARTNERS earliest
candidates under each run, not a row for every pair of a large group. Sets for which none of
these turns out to be similar, though there were more, are searched again with the next ones,
MORE_PARTNERS times as many, until a similar one is found or none is left.

Words and sets go by hashes, words and sets in the join by 64 bits, equal lines by 128.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from fabtrace.llm.common import BATCH_CHARS, Batches, combined, drop, gather, in_batches, pieces_of, stored, values
from fabtrace.llm.shingles import FOLD, mixed

LEAST = 0.8
PARTNERS = 4
MORE_PARTNERS = 1024
RUN = 3
SHARED = 8
COUNT_CELLS = 1 << 22
# Bits of a table of hashes; with more hashes it only lets more rows through.
MOST_BITS = 1 << 27
# Runs and postings a task sends together, words for each range of runs, pairs looked at together.
RUNS_AT_ONCE = 1 << 21
POSTINGS_AT_ONCE = 1 << 18
WORDS_PER_RANGE = 1 << 21
PAIRS_AT_ONCE = 1 << 21
NO_ID = np.iinfo(np.int64).max
_SLACK = 1e-9
_LINES, _RARITY = 20, 20  # bits of a sort key
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD, _GOLDEN = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15)


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of the text, lower-cased (A-Z only), eight bytes at a time."""
    raw = np.frombuffer(b" " + joined.translate(FOLD) + b" " * 9, np.uint8)
    blank = raw == 32
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    at, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(raw) - 8,), np.uint64, raw.data, 1, (1,))  # from every byte on

    def eight(of: np.ndarray, k: int) -> np.ndarray:
        return eights[at[of] + k] & _BYTES[np.minimum(size[of] - k, 8)]

    hashes = mixed((eights[at] & _BYTES[np.minimum(size, 8)]) * _ODD + size.astype(np.uint64) * _GOLDEN)
    longer, k = np.flatnonzero(size > 8), 8
    while len(longer):
        hashes[longer] = mixed(hashes[longer] ^ (eight(longer, k) * _GOLDEN + np.uint64(k)))
        k += 8
        longer = longer[size[longer] > k]
    return hashes, at


def _order(line: np.ndarray, hashes: np.ndarray, rarity: np.ndarray | None) -> np.ndarray:
    """Places of the words by line, then rarity if given, then hash."""
    rest = 64 - _LINES
    key = line.astype(np.uint64) << np.uint64(rest)
    count = None
    if rarity is None:
        key |= hashes >> np.uint64(_LINES)
    else:
        count = rarity[cells(hashes)]
        key |= count.astype(np.uint64) << np.uint64(rest - _RARITY) | hashes >> np.uint64(_LINES + _RARITY)
    order = np.argsort(key)
    k = key[order]
    tie = np.flatnonzero(k[1:] == k[:-1])
    if len(line) and (line[-1] >> _LINES or (hashes[order[tie]] != hashes[order[tie + 1]]).any()):
        # Too many lines for a short key, or words that it can't tell apart.
        return np.lexsort((hashes, line) if count is None else (hashes, count, line))
    return order


def rarities(counts: np.ndarray) -> np.ndarray:
    """How rare the words of each cell are among all cells, in as few bytes as hold it."""
    _, rank = np.unique(np.minimum(counts, (1 << _RARITY) - 1), return_inverse=True)
    return rank.astype(np.min_scalar_type(int(rank.max(initial=0))))


class Sets:
    """The sets of words of all lines of some texts, or of those that are ``wanted`` by text and
    number; lines without words have none.

    words: the sets' words, set after set; first, size: where each begins and its length;
    text, line: the text of each and its number there; a, b: 128 bits that name it.
    """

    def __init__(
        self,
        texts: list[bytes],
        rarity: np.ndarray | None = None,
        wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    ):
        joined = b"\n".join([*texts, b""])
        hashes, at = word_hashes(joined)
        feeds = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        # The words before each line feed are those of its line.
        line = np.repeat(np.arange(len(feeds)), np.diff(np.searchsorted(at, feeds), prepend=0))
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        feeds_before = np.searchsorted(feeds, np.concatenate([[0], ends[:-1] + 1]))
        if wanted is not None:
            own = np.unique(line)
            text = np.searchsorted(feeds_before, own, "right") - 1
            table = np.zeros(len(feeds) + 1, bool)
            table[own] = wanted(text, own - feeds_before[text])
            kept = table[line]
            hashes, line = hashes[kept], line[kept]
        order = _order(line, hashes, rarity)
        hashes = hashes[order]  # lines are in order already
        new = np.ones(len(line), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
        self.words, line = hashes[new], line[new]
        start = np.ones(len(line), bool)
        start[1:] = line[1:] != line[:-1]
        self.first = np.flatnonzero(start)
        self.size = np.diff(np.append(self.first, len(line)))
        line = line[self.first]
        self.text = np.searchsorted(feeds_before, line, "right") - 1
        self.line = line - feeds_before[self.text]

    def _name(self, seed: int) -> np.ndarray:
        return np.add.reduceat(mixed(self.words ^ np.uint64(seed)), self.first) if len(self.first) else self.words

    @cached_property
    def a(self) -> np.ndarray:
        return self._name(0x243F6A8885A308D3)

    @cached_property
    def b(self) -> np.ndarray:
        return self._name(0x13198A2E03707344)

    def bitmap(self) -> np.ndarray:
        """256 bits per set, one for every residue of its words: the parity of how many have it."""
        residue = mixed(self.words) & np.uint64(255)
        bit = np.uint64(1) << (residue & np.uint64(63))
        quarters = [np.where(residue >> np.uint64(6) == of, bit, np.uint64(0)) for of in range(4)]
        if len(self.first):
            quarters = [np.bitwise_xor.reduceat(q, self.first) for q in quarters]
        return np.stack(quarters, 1)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_CELLS.bit_length() + 1)).astype(np.int64)


def _sets(
    batches: Batches, rarity: np.ndarray | None = None, firsts: Broadcast | None = None
) -> Iterator[tuple[pa.RecordBatch, int, Sets]]:
    """The sets of a few texts at a time; with ``firsts`` those that may occur there first."""
    for batch in batches:
        at = 0
        for texts in in_batches((t or b"" for t in values(batch.column("text"))), 2 * BATCH_CHARS):
            n = batch.column("n").to_numpy()[at : at + len(texts)]
            wanted = firsts and (lambda text, line, n=n: among(_place_key(n[text], line.astype(np.int64)), firsts))
            yield batch, at, Sets(texts, rarity, wanted)
            at += len(texts)


def scanned(texts: DataFrame) -> tuple[DataFrame, np.ndarray, str]:
    """Every line with words: n, line, a, b (the name of its set), id; how many words of all texts
    fall in each cell; and the path of the table that holds the lines.

    Rarer words come first in a set. Each task counts its own words and sends the pieces of its
    counts after its lines.
    """

    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.uint32)
        for batch, at, s in _sets(batches):
            # Every word once per line: the order needs no more.
            np.add.at(total, cells(s.words), np.uint32(1))
            n = batch.column("n").to_numpy()[at + s.text]
            line = [pa.array(n), pa.array(s.line.astype(np.int32)), pa.array(s.a.view(np.int64)), pa.array(s.b.view(np.int64))]
            line.append(batch.column("own").take(pa.array(at + s.text)))
            blank = [pa.nulls(len(n), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays(line + blank, [*_LINE, *_PIECE])
        for piece in pieces_of(total.reshape(1, -1)):
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(blank + piece.columns, [*_LINE, *_PIECE])

    found = texts.mapInArrow(rows, "n long, line int, a long, b long, id long, piece long, part long, payload binary")
    table, path = _kept(found)
    counted = table.where("payload IS NOT NULL").select(*_PIECE)
    rarity = combined(counted, texts.rdd.getNumPartitions(), COUNT_CELLS, np.uint32)[0]
    return table.where("payload IS NULL").select(*_LINE), rarity, path


_LINE, _PIECE = ["n", "line", "a", "b", "id"], ["piece", "part", "payload"]


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, and the shuffles that led to the table are gone with it."""
    return stored(df, free=True)


def bits_of(hashes: DataFrame) -> Broadcast:
    """A bit for every hash in the only column."""
    return _bits(hashes, hashes.count(), lambda column: column.to_numpy().view(np.uint64))


def run_bits(runs: DataFrame) -> Broadcast:
    """Two bits for every run of ``repeated_runs``."""

    def hashes(column: pa.Array) -> np.ndarray:
        code = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        return np.concatenate([code, _second(code)])

    return _bits(runs.select("payload"), 2 * (runs.agg(F.sum("runs")).first()[0] or 0), hashes)


def _bits(hashes: DataFrame, count: int, unpacked: Callable[[pa.Array], np.ndarray]) -> Broadcast:
    size = min(MOST_BITS, max(1 << 13, 1 << (16 * max(count, 1) - 1).bit_length()))

    def fill(batches: Batches) -> np.ndarray:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            cell = mixed(unpacked(batch.column(0))) & np.uint64(size - 1)
            np.bitwise_or.at(bits, (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))
        return bits

    return hashes.sparkSession.sparkContext.broadcast(
        gather(hashes, fill, size // 8, np.uint8, combine=np.bitwise_or)[0]
    )


def among(hashes: np.ndarray, bits: Broadcast) -> np.ndarray:
    """Whether each hash may be one of those with a bit."""
    table = bits.value
    cell = mixed(np.ascontiguousarray(hashes).view(np.uint64)) & np.uint64(len(table) * 8 - 1)
    return (table[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _run_length(sizes: np.ndarray, least: float) -> np.ndarray:
    """How many words, RUN at most, sets similar to one of each size share next to each other.

    Of u words that two sets have together, at most d = (1 - least) * u are not shared. They cut
    the u - d shared ones into d + 1 runs at most, so one has q words if u > q * d + q - 1. For
    the smaller set of a pair u is at least its size.
    """
    out = np.ones(len(sizes), np.int64)
    for q in range(2, RUN + 1):
        room = 1 - q * (1 - least)
        if room > _SLACK:
            out[sizes > (q - 1) / room + _SLACK] = q
    return out


def _shared(sizes: np.ndarray, q: int, least: float) -> np.ndarray:
    """How many runs of q words sets share if the smaller has one of these sizes, SHARED at most."""
    spare = sizes - np.floor(q * (1 - least) * sizes + _SLACK) - q + 1
    return np.clip(spare, 1, SHARED).astype(np.int64)


def _runs(s: Sets, sets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and set of the runs among which every similar set shares some; and how many.

    Before the first run of q shared words each word that is not shared follows at most q - 1
    shared ones. With a such words of this set and b of the other, the run ends within
    q * a + (q - 1) * b + q words of this set, and as a <= (1 - least) * size - least * b that
    is at most q * (1 - least) * size + q. Each word more brings one shared run more, as far as
    there are words. A set takes the lengths of all smaller sets it may be similar to, and as
    many runs as the smallest of them shares. Sets of fewer words than can differ and still be
    similar have no runs.
    """
    size = s.size[sets]
    long = np.floor(size * (1 - least) + _SLACK) + np.floor((size + 1) * (1 - least) + _SLACK) > 0
    sets, size = sets[long], size[long]
    smallest = np.ceil(least * size - _SLACK)
    shortest, longest = _run_length(smallest, least), _run_length(size, least)
    out = []
    for q in range(RUN, 0, -1):
        here = (shortest <= q) & (q <= longest)
        if not here.any():
            continue
        n = size[here]
        end = np.floor(q * (1 - least) * n + _SLACK).astype(np.int64) + q + _shared(n, q, least) - 1
        count, shared = np.zeros((2, len(s.size)), np.int64)
        count[sets[here]] = np.maximum(np.minimum(n, end) - q + 1, 0)
        # Sets of a shorter run than q are met under that.
        low = np.where(shortest[here] < q, np.floor((q - 1) / (1 - q * (1 - least)) + _SLACK) + 1, smallest[here])
        shared[sets[here]] = _shared(low, q, least)
        place = np.arange(len(s.words)) - np.repeat(s.first, s.size)
        at = np.flatnonzero(place < np.repeat(count, s.size))
        run = s.words * (_GOLDEN + np.uint64(2 * q))
        for k in range(1, q):
            run[:-k] += s.words[k:] * (_ODD + np.uint64(2 * k))
        of = np.repeat(np.arange(len(s.size)), s.size)[at]
        out.append([mixed(run[at]), place[at], of, shared[of]])
    if not out:
        return np.zeros(0, np.uint64), *np.zeros((3, 0), np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _under(run: np.ndarray, of: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Places of the runs to send each set under: the first, but as many fewer as are shared less one.

    Runs come by length, then by place: the same order for all sets, with the rarest words first.
    """
    order = np.lexsort((shared, of))
    own, need = of[order], shared[order]
    start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (need[1:] != need[:-1])])) if len(own) else own
    count = np.diff(np.append(start, len(own)))
    number = np.arange(len(own)) - np.repeat(start, count)
    return order[number <= np.repeat(count, count) - need]


def _second(code: np.ndarray) -> np.ndarray:
    return mixed(code.view(np.uint64) ^ _ODD)


def _place_key(n, line):
    """One number for a line's place; ``n`` and ``line`` are arrays of 64 bits, or columns."""
    if isinstance(n, Column):
        return n.bitwiseXOR(F.shiftleft(line.cast("long"), 44))
    return n ^ line << 44


def _range(run: np.ndarray, spread: int) -> np.ndarray:
    """The range of hashes that a run is in; there are 2 ** spread."""
    return run >> np.uint64(64 - spread) if spread else np.zeros_like(run)


def _in_range(run: np.ndarray, spread: int) -> np.ndarray:
    """The 32 bits of a run that tell it from others of its range."""
    return ((run << np.uint64(spread)) >> np.uint64(32)).astype(np.uint32)


def _by_range(run: np.ndarray, columns: list[np.ndarray], spread: int) -> pa.RecordBatch:
    """A row for each range: the runs in order, as steps, and the columns beside them, byte by byte."""
    if columns:
        order = np.argsort(run)
        run, columns = run[order], [c[order] for c in columns]
    else:
        run = np.sort(run)
    of, key = _range(run, spread), _in_range(run, spread)
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    ends = np.append(start, len(of))
    payload = [_payload(key[a:b], [c[a:b] for c in columns]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    columns = [pa.array(of[start].astype(np.int64)), pa.array(np.diff(ends)), pa.array(payload, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["range", "runs", "payload"])


def _payload(key: np.ndarray, columns: list[np.ndarray]) -> bytes:
    step = np.diff(key, prepend=np.uint32(0))
    return b"".join(c.view(np.uint8).reshape(len(key), -1).T.tobytes() for c in [step, *columns])


_BY_RANGE = "range long, runs long, payload binary"


def _unpacked(rows: pa.Table, types: list[type]) -> list[np.ndarray]:
    """The runs and the columns beside them of all rows; of the last type are all that follow."""
    out = []
    for n, payload in zip(rows.column("runs").to_pylist(), rows.column("payload").to_pylist(), strict=True):
        raw, at, columns = np.frombuffer(payload, np.uint8).reshape(-1, n), 0, []
        while at < len(raw):
            kind = np.dtype(np.uint32 if not columns else types[min(len(columns), len(types)) - 1])
            columns.append(np.ascontiguousarray(raw[at : at + kind.itemsize].T).view(kind).ravel())
            at += kind.itemsize
        columns[0] = np.cumsum(columns[0], dtype=np.uint32)
        out.append(columns)
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def repeated_runs(texts: DataFrame, firsts: Broadcast, rarity: Broadcast, least: float, spread: int) -> DataFrame:
    """Every run that occurs again, those of a range in one row.

    ``firsts`` has the places where sets occur first; a set is taken there only. Runs of one
    range come to one task, in two or three bytes each.
    """

    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for _, _, s in _sets(batches, rarity.value, firsts):
            run, *_ = _runs(s, np.arange(len(s.size)), least)
            held.append(run)
            count += len(run)
            if count > RUNS_AT_ONCE:
                yield _by_range(np.concatenate(held), [], spread)
                held, count = [], 0
        if count:
            yield _by_range(np.concatenate(held), [], spread)

    def again(key, rows):
        (run,) = _unpacked(rows, [])
        run.sort()
        code = np.uint64(key[0].as_py() << 32) | np.unique(run[1:][run[1:] == run[:-1]]).astype(np.uint64)
        return pa.table({"runs": pa.array([len(code)], pa.int64()), "payload": pa.array([code.tobytes()], pa.binary())})

    return texts.mapInArrow(rows, _BY_RANGE).groupBy("range").applyInArrow(again, "runs long, payload binary")


def postings(
    texts: DataFrame, firsts: Broadcast, rarity: Broadcast, least: float, spread: int, only: Broadcast
) -> DataFrame:
    """The runs to send every set under, by range, with its name, id, size, place and bits."""
    bitmap = Sets.bitmap

    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch, at, s in _sets(batches, rarity.value, firsts):
            run, place, of, shared = _runs(s, np.arange(len(s.size)), least)
            code = _range(run, spread) << np.uint64(32) | _in_range(run, spread).astype(np.uint64)
            kept = np.flatnonzero(among(code, only))
            kept = kept[among(_second(code[kept]), only)]
            kept = kept[_under(run[kept], of[kept], shared[kept])]
            run, place, of = run[kept], place[kept], of[kept]
            ids = batch.column("id").to_numpy()[at + s.text[of]]
            bits = bitmap(s).reshape(len(s.first), -1)[of]
            held.append([run, s.a[of], ids, s.size[of].astype(np.int32), place.astype(np.int32), *bits.T])
            count += len(run)
            if count > POSTINGS_AT_ONCE:
                run, *columns = map(np.concatenate, zip(*held, strict=True))
                yield _by_range(run, columns, spread)
                held, count = [], 0
        if count:
            run, *columns = map(np.concatenate, zip(*held, strict=True))
            yield _by_range(run, columns, spread)

    return texts.mapInArrow(rows, _BY_RANGE)


_POSTING = [np.int64, np.int64, np.int32, np.int32, np.uint64]  # name, id, size, place, bits


def _passing(
    run, name, ids, size, place, bits, wanted, least: float, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of postings of one run that pass the filters, the second no earlier than the first,
    and how many of the second's come before.

    Postings come by run, id and name. Each ``wanted`` one meets the earliest of its run first, a
    block at a time and each larger than the last, until more than ``most`` pass or none is left.
    """
    n = len(run)
    new_run = np.concatenate([[True], run[1:] != run[:-1]])
    new_id = new_run | np.concatenate([[True], ids[1:] != ids[:-1]])
    start = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
    end = np.append(np.flatnonzero(new_id), n)[np.cumsum(new_id)]  # of those no later
    found = np.zeros(n, np.int64)
    left, met, block = np.flatnonzero(wanted & (end - start > 1)), 0, 16
    while len(left):
        at, step = 0, max(1, PAIRS_AT_ONCE // block)
        while at < len(left):
            own = left[at : at + step]
            count = np.minimum(end[own] - start[own] - met, block)
            j = np.repeat(own, count)
            i = start[j] + met + np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count)
            both = size[i] + size[j]
            room = both - 2 * np.ceil(both * (least / (1 + least)) - _SLACK).astype(np.int64)
            before = place[i] - place[j]
            passes = np.abs(before) + np.abs(size[i] - size[j] - before) <= room
            passes &= name[i] != name[j]
            i, j, room = i[passes], j[passes], room[passes]
            differ = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits)
            i, j = i[differ <= room], j[differ <= room]
            first = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]])) if len(j) else j
            count = np.diff(np.append(first, len(j)))
            number = found[j] + np.arange(len(j)) - np.repeat(first, count)
            found[j[first]] += count
            kept = number <= most  # one beyond, to know of more
            yield i[kept], j[kept], number[kept]
            at += step
        met += block
        block = min(2 * block, PAIRS_AT_ONCE)
        left = left[(found[left] <= most) & (end[left] - start[left] > met)]


def _by_run(run: np.ndarray, ids: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Places of the postings by run, id and name."""
    low = int(ids.min(initial=0))
    if int(ids.max(initial=0)) - low >> 32:
        return np.lexsort((name, ids, run))
    return _sorted_by(run.astype(np.uint64) << np.uint64(32) | (ids - low).astype(np.uint64), name)


def candidates(posts: DataFrame, least: float, done: int, most: int, of: Broadcast | None = None) -> DataFrame:
    """Pairs of set names (x, y), and whether y has ``more`` candidates under a run; and, in rows
    of their own, the postings of the runs under which any set has more.

    For each set y (of those named in ``of``, if given) the candidates with the least ids no
    larger than its own, under every run: all up to the ``most``th but the first ``done``. A
    task holds the postings of a range of runs together. A pair may come from several ranges.
    """

    def chosen(key, rows):
        run, name, ids, size, place, *bits = _unpacked(rows, _POSTING)
        order = _by_run(run, ids, name)
        run, name, ids, size, place, *bits = (
            c[order] for c in (run, name, ids, size.astype(np.int64), place.astype(np.int64), *bits)
        )
        wanted = np.ones(len(name), bool) if of is None else among(name, of)
        parts = [(np.zeros(0, np.int64),) * 3, *_passing(run, name, ids, size, place, bits, wanted, least, most)]
        x, y, number = map(np.concatenate, zip(*parts, strict=True))
        more = np.zeros(len(name), bool)
        more[y[number == most]] = True
        kept = (number >= done) & (number < most)
        x, y = x[kept], y[kept]
        found = pa.table({"x": pa.array(name[x]), "y": pa.array(name[y]), "more": pa.array(more[y])})
        found = found.group_by(["x", "y"]).aggregate([("more", "max")]).rename_columns(["x", "y", "more"])
        again = np.isin(run, run[more])
        columns = [name, ids, size.astype(np.int32), place.astype(np.int32), *bits]
        payload = _payload(run[again], [c[again] for c in columns]) if again.any() else b""
        left = pa.table({"range": [key[0].as_py()], "runs": [int(again.sum())], "payload": pa.array([payload], pa.binary())})
        left = left.slice(0, int(again.any()))
        return pa.concat_tables([found, left], promote_options="default").select(_FOUND)

    return posts.groupBy("range").applyInArrow(chosen, f"x long, y long, more boolean, {_BY_RANGE}")


_FOUND = ["x", "y", "more", "range", "runs", "payload"]


def _may(column: str, bits: Broadcast) -> Column:
    @F.arrow_udf(BooleanType())
    def may(hashes: pa.Array) -> pa.Array:
        return pa.array(among(hashes.to_numpy(), bits))

    return may(column)


def _words_of(texts: DataFrame, firsts: DataFrame, names: DataFrame) -> tuple[DataFrame, str]:
    """name, first and words (64-bit hashes, in order) of every named set, from where it occurs first."""
    names, names_path = _kept(names.distinct())
    places = firsts.where(_may("name", bits_of(names))).join(names, "name").groupBy("name").agg(F.min("first").alias("first"))
    wanted = F.collect_list(F.struct(F.col("first.line").alias("line"), "name", "first")).alias("wanted")
    places, path = _kept(places.groupBy(F.col("first.n").alias("n")).agg(wanted))

    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lines = [], []
            for text, wanted in zip(values(batch.column("text")), values(batch.column("wanted")), strict=True):
                split = text.split(b"\n")
                found += wanted
                lines += [split[w["line"]] for w in wanted]
            s = Sets(lines)
            words = [s.words[a : a + n].tobytes() for a, n in zip(s.first, s.size, strict=True)]
            found = [found[t] for t in s.text]
            firsts = pa.array([w["first"] for w in found], batch.schema.field("wanted").type.value_type.field("first").type)
            columns = [pa.array([w["name"] for w in found], pa.int64()), firsts, pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "first", "words"])

    first = firsts.schema["first"].dataType.simpleString()
    found = texts.where(_may("n", bits_of(places.select("n")))).join(places, "n").select("text", "wanted")
    out, out_path = _kept(found.mapInArrow(rows, f"name long, first {first}, words binary"))
    for done in (names_path, path):
        drop(texts.sparkSession, done)
    return out, out_path


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all sets of a column, and how many each has."""
    sizes = np.array([len(w) // 8 for w in words.to_pylist()], np.int64)
    return np.frombuffer(b"".join(words.to_pylist()), np.uint64), sizes


def _by_pair(pair: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the words by pair, then hash."""
    bits = max(1, int(pair.max(initial=0)).bit_length())
    return _sorted_by(pair.astype(np.uint64) << np.uint64(64 - bits) | words >> np.uint64(bits), words)


def _sorted_by(key: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Places by key, then by ``then``, which is looked at only where keys are equal."""
    order = np.argsort(key)
    k = key[order]
    tie = k[1:] == k[:-1]
    at = np.flatnonzero(np.append(tie, False) | np.append(False, tie)) if tie.any() else []
    if len(at):
        order[at] = order[at][np.lexsort((then[order[at]], k[at]))]
    return order


def similar(x: Column, y: Column, least: float) -> Column:
    @F.arrow_udf(BooleanType())
    def test(xs: pa.Array, ys: pa.Array) -> pa.Array:
        (a, in_a), (b, in_b) = _flat(xs), _flat(ys)
        words = np.concatenate([a, b])
        pair = np.concatenate([np.repeat(np.arange(len(xs)), in_a), np.repeat(np.arange(len(ys)), in_b)])
        order = _by_pair(pair, words)
        words, pair = words[order], pair[order]
        twice = (words[1:] == words[:-1]) & (pair[1:] == pair[:-1])
        both = np.bincount(pair[1:][twice], minlength=len(xs))
        return pa.array(both >= least * (in_a + in_b - both) - _SLACK)

    return test(x, y)


def _matches(texts: DataFrame, firsts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """For every set with an earlier similar one among the pairs: its name and that one's place."""
    words, path = _words_of(texts, firsts, pairs.select(F.explode(F.array("x", "y")).alias("name")))
    found = (
        pairs.select("x", "y")
        .join(words.toDF("x", "at_x", "words_x"), "x")
        .join(words.toDF("y", "at_y", "words_y"), "y")
        .where(similar(F.col("words_x"), F.col("words_y"), least))
    )
    earlier = F.col("at_x") < F.col("at_y")
    out, _ = _kept(
        found.select(F.when(earlier, F.col("y")).otherwise(F.col("x")).alias("name"), F.least("at_x", "at_y").alias("at"))
        .groupBy("name")
        .agg(F.min("at").alias("near"))
    )
    drop(texts.sparkSession, path)
    return out


def earlier_matches(texts: DataFrame, firsts: DataFrame, rarity: np.ndarray, least: float = LEAST) -> DataFrame:
    """name and ``near`` of sets that have a similar one before them, every such set at least once.

    ``texts`` has n, id and text; ``firsts`` the place (a struct that orders, with n and line) of
    the first line of every set, by name; ``rarity`` how many words fall in each cell.
    """
    spark = texts.sparkSession
    # So many ranges that each has about as many runs, however many there are.
    spread = min(32, max(0, int(rarity.sum(dtype=np.int64)) // WORDS_PER_RANGE).bit_length())
    order = spark.sparkContext.broadcast(rarities(rarity))
    at_first = bits_of(firsts.select(_place_key(F.col("first.n"), F.col("first.line")).alias("key")))
    again, again_path = _kept(repeated_runs(texts, at_first, order, least, spread))
    repeated = run_bits(again)
    drop(spark, again_path)
    return _search(postings(texts, at_first, order, least, spread, repeated), texts, firsts, least, 0, PARTNERS, None)


def _search(posts: DataFrame, texts: DataFrame, firsts: DataFrame, least: float, done: int, most: int, of: Broadcast | None) -> DataFrame:
    """The matches among the candidates from the ``done``th to the ``most``th, and those of the
    sets that have none there, though more candidates, among their next ones."""
    spark = posts.sparkSession
    found, found_path = _kept(candidates(posts, least, done, most, of))
    pairs, path = _kept(found.where("payload IS NULL").groupBy("x", "y").agg(F.max("more").alias("more")))
    left = found.where("payload IS NOT NULL").select("range", "runs", "payload")
    matches = _matches(texts, firsts, pairs, least)
    rest, rest_path = _kept(pairs.where("more").select(F.col("y").alias("name")).distinct().join(matches, "name", "left_anti"))
    drop(spark, path)
    if rest.limit(1).count():
        next_most = most + MORE_PARTNERS * (most - done)
        matches = matches.unionByName(_search_again(left, texts, firsts, least, most, next_most, bits_of(rest)))
    for done_path in (rest_path, found_path):
        drop(spark, done_path)
    return matches


def _search_again(posts: DataFrame, texts: DataFrame, firsts: DataFrame, least: float, done: int, most: int, of: Broadcast) -> DataFrame:
    """``_search`` for the sets named in ``of``."""
    return _search(posts, texts, firsts, least, done, most, of)


def mark(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: ``row`` (its own columns) and what becomes of its lines.

    Lines rank by document id (a null one last; of rows with one id, the first read first), then
    by place. A line goes if an earlier line has the same words or a similar set of them.
    Lines without words stay. n_lines and n_removed count lines; removed has, by line, the number
    of the removed line and the document and line of an earlier one it is equal or similar to;
    kept_text is the rest of the text. Ids are whole numbers. Null and empty texts have no
    lines, and null stays null.
    """
    base, _ = _kept(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")))
    text, own_id = F.col("row").getField(text_column), F.col("row").getField(id_column).cast("long")
    texts = base.select("n", F.coalesce(own_id, F.lit(int(NO_ID))).alias("id"), text.cast("binary").alias("text"))
    lines, rarity, _ = scanned(base.select("n", own_id.alias("own"), text.cast("binary").alias("text")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "n", "line")
    firsts, _ = _kept(
        lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    )
    near = earlier_matches(texts, firsts.select(F.col("a").alias("name"), "first"), rarity, least)
    near = near.groupBy(F.col("name").alias("a")).agg(F.min("near").alias("near"))
    lowest, _ = _kept(
        firsts.join(near, "a", "left")
        .where("times > 1 OR near IS NOT NULL")
        .select("a", "b", F.least("first", "near").alias("low"))
    )
    # Read from a table, this side leaves Spark free to split the lines of a frequent set.
    later = (F.col("n") != F.col("low.n")) | (F.col("line") != F.col("low.line"))
    found = F.struct("line", F.col("low.id").alias("first_id"), F.col("low.line").alias("first_line"))
    of_doc = lines.join(lowest, ["a", "b"]).where(later).groupBy("n").agg(F.array_sort(F.collect_list(found)).alias("removed"))
    removed = F.coalesce("removed", F.array().cast("array<struct<line:int,first_id:bigint,first_line:int>>"))
    out = base.join(of_doc.hint("shuffle_hash"), "n", "left").withColumn("gone", removed).withColumn("split", F.split(text, "\n"))
    gone = F.transform("gone", lambda g: g["line"])
    left = F.array_join(F.filter("split", lambda x, i: ~F.array_contains(gone, i)), "\n")
    return out.select(
        "row",
        F.when(text != "", F.size("split").cast("long")).otherwise(0).alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.col("gone").alias("removed"),
        F.when(F.size("gone") > 0, left).otherwise(text).alias("kept_text"),
    )
