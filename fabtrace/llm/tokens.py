"""Token ids in files of canonical, length-limited Huffman codes.

A file set has three tables: ``codebook`` (id, code length), ``parts`` (part, ids in all parts
before) and ``documents``, one row per document in ascending id order: the part, the ids
before it in the part, the number of its ids, its coded bits, and for every BLOCK ids the bit
offset at which a reader can begin.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from fabtrace.llm.common import Batches, drop, gather, stored

# Ids between two checkpoints.
BLOCK = 512
# Longest code: two bits more than equal codes would need, at least LEAST_LIMIT.
LEAST_LIMIT, SPARE_BITS, MOST_LIMIT = 16, 2, 24
# Ids coded or decoded at once by a task, and words it keeps the ids of; only memory and
# speed depend on them.
IDS_AT_ONCE = 1 << 19
WORDS_KEPT = 600_000
# Bytes of text whose words are looked up together, and words the library gets at once.
BYTES_AT_ONCE = 1 << 23
WORDS_AT_ONCE = 1 << 12


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Best code length of each id, none over ``limit``, by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    least = int(len(used) - 1).bit_length()
    limit = limit or min(MOST_LIMIT, max(LEAST_LIMIT, least + SPARE_BITS))
    if not least <= limit <= MOST_LIMIT:
        raise ValueError(f"{len(used)} ids don't fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        merged = np.argsort(both, kind="stable")
        levels.append(merged < len(weights))
        both = both[merged]
        even = len(both) // 2 * 2
        packages = both[0:even:2] + both[1:even:2]
    need = 2 * len(order) - 2
    by_rank = np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:need].sum())
        by_rank[:leaves] += 1
        need = 2 * (need - leaves)
    lengths[order] = by_rank
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each id, and the table that a reader looks the next bits up in.

    An entry of the table holds an id, shifted by 5 bits, and the length of its code.
    """
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    limit = int(lengths.max(initial=1))
    spans = 1 << (limit - lengths[order])
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = (np.cumsum(spans) - spans) >> (limit - lengths[order])
    table = np.zeros(1 << limit, np.int64)
    filled = np.repeat(order << 5 | lengths[order], spans)
    table[: len(filled)] = filled
    return codes, table


def pack(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Bits of consecutive documents of the given sizes, each from a new byte; checkpoints."""
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    doc_bits = ends[first[1:]] - ends[first[:-1]]
    doc_bytes = (doc_bits + 7) // 8
    doc_at = np.concatenate([[0], np.cumsum(doc_bytes)])
    at = ends[:-1] + np.repeat(doc_at[:-1] * 8 - ends[first[:-1]], sizes)
    spread = (int(lengths.max(initial=1)) + 14) // 8  # bytes that a code can touch
    value = codes[ids] << (8 * spread - (at & 7) - size)
    out = np.zeros(int(doc_at[-1]) + spread)
    for k in range(spread):
        out += np.bincount((at >> 3) + k, (value >> (8 * (spread - 1 - k))) & 255, len(out))
    raw = out.astype(np.uint8).tobytes()
    bits, checkpoints = [], []
    for i in range(len(sizes)):
        bits.append(raw[doc_at[i] : doc_at[i + 1]])
        starts = at[first[i] : first[i + 1] : BLOCK] - doc_at[i] * 8
        checkpoints.append(starts.astype("<u8").tobytes())
    return bits, checkpoints


def unpack(bits: list[bytes], checkpoints: list[bytes], sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of all documents, one after the other; every block is read on its own, side by side."""
    limit = len(table).bit_length() - 1
    sizes = np.asarray(sizes, np.int64)
    raw = np.frombuffer(b"".join([*bits, bytes(4)]), np.uint8).astype(np.int64)
    word = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]
    doc_at = np.concatenate([[0], np.cumsum([len(b) for b in bits])])[:-1] * 8
    blocks = (sizes + BLOCK - 1) // BLOCK
    doc = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.frombuffer(b"".join(checkpoints), "<u8").astype(np.int64) + doc_at[doc]
    left = np.minimum(BLOCK, sizes[doc] - nth * BLOCK)
    to = (np.cumsum(sizes) - sizes)[doc] + nth * BLOCK
    order = np.argsort(-left, kind="stable")
    at, to, left = at[order], to[order], left[order]
    out = np.zeros(int(sizes.sum()), np.uint32)
    mask, shift = (1 << limit) - 1, 40 - limit
    for step in range(int(left.max(initial=0))):
        live = int(np.searchsorted(-left, -step, "left"))
        at, to = at[:live], to[:live]
        found = table[(word[at >> 3] >> (shift - (at & 7))) & mask]
        out[to + step] = found >> 5
        at = at + (found & 31)
    return out


def _parts(sizes: list[int], most: int = IDS_AT_ONCE) -> Iterator[slice]:
    """Consecutive rows with ``most`` ids or bytes in all (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def write(tokens: DataFrame, path: str, vocabulary: int, limit: int | None = None) -> None:
    """Write (id, ids) rows as a file set.

    ``id`` is a long (null ids come first), ``ids`` a binary of little-endian unsigned 32-bit
    integers below ``vocabulary``; null counts as no ids. Rows with equal ids of document stand
    together, in the order of their bits. Other columns are left out.
    """
    spark = tokens.sparkSession
    rows, raw_path = stored(tokens.select("id", F.coalesce("ids", F.lit(b"")).alias("ids")))

    def count(batches: Batches) -> np.ndarray:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = b"".join(batch.column(0).slice(at, 256).to_pylist())
                found = np.bincount(np.frombuffer(ids, "<u4"), minlength=vocabulary)
                if len(found) > vocabulary:
                    raise ValueError(f"an id is not below {vocabulary}")
                total += found
        return total

    counts = gather(rows.select("ids"), count, vocabulary, np.int64)[0]
    lengths = code_lengths(counts, limit)
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((canonical(lengths)[0], lengths))

    def code(batches: Batches) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        for batch in batches:
            names, all_ids = batch.column("id"), batch.column("ids").to_pylist()
            sizes = [len(b) // 4 for b in all_ids]
            for own in _parts(sizes):
                ids = np.frombuffer(b"".join(all_ids[own]), "<u4")
                bits, checkpoints = pack(ids, np.array(sizes[own], np.int64), codes, lengths)
                yield pa.record_batch(
                    {
                        "id": names[own],
                        "n_tokens": pa.array(sizes[own], pa.int64()),
                        "checkpoints": pa.array(checkpoints, pa.binary()),
                        "bits": pa.array(bits, pa.binary()),
                    }
                )

    schema = "id long, n_tokens long, checkpoints binary, bits binary"
    coded, coded_path = stored(rows.mapInArrow(code, schema))
    drop(spark, raw_path)

    def number(batches: Batches) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            start = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part)), pa.array(start), *batch.columns],
                ["part", "start", *batch.schema.names],
            )

    order = ["id", F.crc32("bits"), "n_tokens"]
    coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        number, f"part long, start long, {schema}"
    ).write.option("compression", "none").parquet(f"{path}/documents")
    drop(spark, coded_path)
    sizes = spark.read.parquet(f"{path}/documents").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    found = sorted((r.part, r.n) for r in sizes.collect())  # a row per part
    starts = itertools.accumulate((n for _, n in found), initial=0)
    table = [(p, s) for (p, _), s in zip(found, starts, strict=False)]
    spark.createDataFrame(table, "part long, before long").coalesce(1).write.parquet(f"{path}/parts")



def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    lengths = {r.id: r.length for r in spark.read.parquet(f"{path}/codebook").collect()}
    by_id = np.zeros(max(lengths, default=0) + 1, np.int64)
    for i, n in lengths.items():
        by_id[i] = n
    shared = spark.sparkContext.broadcast(canonical(by_id)[1])

    def decode(batches: Batches) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            bits, checkpoints = batch.column("bits").to_pylist(), batch.column("checkpoints").to_pylist()
            sizes = batch.column("n_tokens").to_pylist()
            for own in _parts(sizes):
                ids = unpack(bits[own], checkpoints[own], np.array(sizes[own], np.int64), table)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum([0, *sizes[own]]) * 4
                yield pa.record_batch(
                    {
                        "part": batch.column("part")[own],
                        "start": batch.column("start")[own],
                        "id": batch.column("id")[own],
                        "n_tokens": pa.array(sizes[own], pa.int64()),
                        "ids": pa.array([raw[a:b] for a, b in itertools.pairwise(ends)], pa.binary()),
                    }
                )

    rows = spark.read.parquet(f"{path}/documents").mapInArrow(
        decode, "part long, start long, id long, n_tokens long, ids binary"
    )
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))
    return rows.join(parts, "part").select(
        "id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


# A word of Latin-1 letters and what may end it. The tokenizer below lower-cases it, keeps its
# letters together and takes the end by itself.
_PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<end>[.,!#$%&*]*)$"
_STEPS = ("NFC", "Replace", "Lowercase")
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """The library's tokenizer, given every word between two blanks or line feeds once.

    It drops white space, and nothing in it reaches across a blank or line feed. Plain words,
    lower-cased and without the marks behind them, go to a copy of the tokenizer
    without normaliser and word pattern, which would change nothing in them.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(source)
        normalizer, cut, model = spec["normalizer"], spec["pre_tokenizer"], spec["model"]
        steps = tuple(n["type"] for n in (normalizer or {}).get("normalizers", []))
        patterns = [c.get("pattern", {}).get("Regex") for c in (cut or {}).get("pretokenizers", [])]
        if steps != _STEPS or patterns != [_LETTERS, None]:
            raise ValueError("not a tokenizer of lower-cased words that drops white space")
        self.library, self.plain = Tokenizer.from_str(source), Tokenizer.from_str(source)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known, self.others = Known(), Known()  # plain words, and what goes to the library
        # Whether an id ends a word.
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix := model.get("end_of_word_suffix"):
            self.last[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        return _joined(self.library.encode_batch_fast(words, add_special_tokens=False))

    def _by_plain(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, as one text that is cut where a word ends."""
        found = self.plain.encode_batch_fast([stems], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(stems):  # a word has an end that is not in the vocabulary
            return _joined(self.plain.encode_batch_fast(stems, add_special_tokens=False))
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of each text and then the end."""
        return self.encode_array(pa.array(texts, pa.string()), end).to_pylist()

    def encode_array(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The same for an array without nulls.

        The ids of every distinct word are put together from those of its letters and its end, and
        those of a text from its words'.
        """
        for known in (self.known, self.others):
            if len(known) > WORDS_KEPT:
                known.clear()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        order = split.flatten().dictionary_encode()
        words = order.dictionary
        cut = pc.extract_regex(words, _PLAIN)
        plain = cut.is_valid()
        cut, others = cut.filter(plain), words.filter(pc.invert(plain))
        stems = pc.utf8_lower(pc.struct_field(cut, "letters")).dictionary_encode()
        marks = pc.struct_field(cut, "end").dictionary_encode()
        stem = self.known.numbers(stems.dictionary, self._by_plain)
        others = pa.concat_arrays([others, marks.dictionary]).dictionary_encode()
        other = self.others.numbers(others.dictionary, self._by_library)[others.indices.to_numpy()] + len(self.known)
        n = len(other) - len(marks.dictionary)
        mark = other[n:]
        nothing = len(self.known) + len(self.others)

        plain = plain.to_numpy(zero_copy_only=False)
        first, last = np.zeros(len(words), np.int64), np.full(len(words), nothing)
        first[plain], last[plain] = stem[stems.indices.to_numpy()], mark[marks.indices.to_numpy()]
        first[~plain] = other[:n]
        # The last word is the end of a text.
        which = np.append(np.stack([first, last], 1).ravel(), [nothing, nothing + 1])
        end_ids = np.frombuffer(end, "<u4")
        ids = np.concatenate([self.known.ids, self.others.ids, end_ids])
        parts = _binary(ids, np.concatenate([self.known.sizes, self.others.sizes, [0, len(end_ids)]]))
        ends = _ends(parts.take(pa.array(which)))
        whole = _binary(ends[0], np.diff(ends[1], prepend=0).reshape(-1, 2).sum(1) // 4)

        text_ends = np.cumsum(pc.list_value_length(split).to_numpy())
        which = np.insert(order.indices.to_numpy(), text_ends, len(words))
        ids, ends = _ends(whole.take(pa.array(which)))
        offsets = np.append(0, ends[text_ends + np.arange(len(texts))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


class Known:
    """The words met so far, and the ids of all of them, one after the other."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.sizes)

    def numbers(self, words: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of distinct words among those known; new ones are encoded."""
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self) + np.arange(len(new))
        if len(new):
            own = [encode(new[k : k + WORDS_AT_ONCE].to_pylist()) for k in range(0, len(new), WORDS_AT_ONCE)]
            self.words = pa.concat_arrays([self.words, new])
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in own)])
            self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in own)])
        return at


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive ids as an array of binaries with so many ids each."""
    offsets = pa.array(np.append(0, np.cumsum(sizes) * 4), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(ids)])


def _ends(taken: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all binaries, one after the other, and the byte where each ends."""
    ends = np.frombuffer(taken.buffers()[1], np.int32)[1 : len(taken) + 1]
    raw = taken.buffers()[2]
    size = int(ends[-1]) if len(ends) else 0
    return np.frombuffer(raw, np.uint8, size).view("<u4") if size else np.zeros(0, "<u4"), ends

def _joined(found: list) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in found]
    return np.array(list(itertools.chain.from_iterable(ids)), "<u4"), np.array([len(i) for i in ids], np.int64)


_MADE: dict[int, Words] = {}


def _tokenizer(source: str) -> Words:
    """The tokenizer of this Python worker and the words whose ids it knows."""
    key = hash(source)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Words(source)
    return _MADE[key]


def load(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file, sent to all tasks; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    Words(source)
    return spark.sparkContext.broadcast(source)


def tokenize(text: Column, tokenizer: Broadcast, end: int) -> Column:
    """Ids of a text and then the end id, as little-endian unsigned 32-bit integers.

    Null counts as empty.
    """

    @F.arrow_udf(BinaryType())
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, last = _tokenizer(tokenizer.value), np.array([end], "<u4").tobytes()
        for texts in batches:
            if not len(texts):
                yield pa.array([], pa.binary())
            texts = pc.fill_null(texts, "")
            for own in _parts(pc.binary_length(texts).to_pylist(), BYTES_AT_ONCE):
                yield words.encode_array(texts[own], last)

    return ids(text)
