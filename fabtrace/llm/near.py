"""Near-duplicate documents: consistent weighted sampling of word shingles, banded and verified.

1. Document frequencies of all shingles are counted in a table of fixed size.
2. Every text gets BANDS x ROWS improved consistent weighted samples of its shingles, weighted
   by damped TF-IDF. Two texts agree in a sample with the probability of their weighted Jaccard
   similarity. Texts that agree in all samples of a band share a bucket.
3. In every bucket all texts are compared with its leader, the one with most company.
4. In a bucket whose texts aren't all linked by then, all texts of different classes are
   compared, block by block, and a link is kept for each two classes that meet. So texts that
   share a bucket and are similar always end in one class, without a row for every pair.
5. Classes are the connected components of the verified links.

Texts with the same words are one text until the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from fabtrace.llm.common import BATCH_CHARS, Batches, drop, gather, in_batches, stored, values
from fabtrace.llm.decontaminate import words as words_of
from fabtrace.llm.graph import components
from fabtrace.llm.lines import among, bits_of
from fabtrace.llm.shingles import counted, mixed, shingle_hashes, word_hashes

SIMILAR = 0.8
ROWS, BANDS = 4, 16
FREQUENCY_CELLS = 1 << 20
# How much the inverse document frequency adds to a weight at most. With more, the many copies
# of a text would make their common shingles light and their differences heavy, so that large
# groups of near copies fall below the threshold.
IDF_SHARE = 0.1
# Texts of a bucket compared with each other by one task.
BLOCK = 256
_SHINGLES_AT_ONCE = 512

Shingles = tuple[np.ndarray, np.ndarray, np.ndarray]


def shingles(texts: list[bytes]) -> Shingles:
    return counted(*shingle_hashes(*word_hashes(texts)))


def frequency_cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FREQUENCY_CELLS.bit_length() + 1)).astype(np.int64)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Weight factor of every cell of shingles, from all rows of the binary column ``text``."""

    def fill(batches: Batches) -> np.ndarray:
        total = np.zeros(FREQUENCY_CELLS + 1, np.uint32)
        for batch in batches:
            total[-1] += batch.num_rows
            for part in in_batches((t or b"" for t in values(batch.column("text"))), 4 * BATCH_CHARS):
                np.add.at(total, frequency_cells(shingles(part)[0]), np.uint32(1))
        return total

    found = gather(docs.select("text"), fill, FREQUENCY_CELLS + 1, np.uint32)[0].astype(np.float64)
    n = max(found[-1], 2.0)
    rarity = np.log(n / np.clip(found[:-1], 1, n)) / np.log(n)
    return (1 + IDF_SHARE * rarity).astype(np.float32)


def weights(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(times.astype(np.float32))) * idf[frequency_cells(hashes)]


def _seeds(samples: int) -> np.ndarray:
    return mixed(np.arange(1, 4 * samples + 1, dtype=np.uint64)).astype(np.uint32).reshape(4, samples) | np.uint32(1)


def _bits(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = low * a
    x += high * b
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """16 bits as a number between 0 and 1."""
    return (x.astype(np.float32) + np.float32(0.5)) * np.float32(1 / 65536)


def samples(hashes: np.ndarray, weight: np.ndarray, first: np.ndarray, n: int = ROWS * BANDS) -> np.ndarray:
    """Improved consistent weighted samples of every text, as 32-bit names.

    ``first`` has the place of each text's first shingle; every text has one at least. For
    each shingle, r and c are drawn from Gamma(2, 1) and b from (0, 1) by its hash; with
    t = floor(ln w / r + b), the sample is the (shingle, t) of the least c exp(-r (t - b + 1)).
    """
    s = _seeds(n)
    out = np.full((len(first), n), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
        h = hashes[at : at + _SHINGLES_AT_ONCE]
        low, high = h.astype(np.uint32)[:, None], (h >> np.uint64(32)).astype(np.uint32)[:, None]
        one, two = _bits(low, high, s[0], s[1]), _bits(low, high, s[2], s[3])
        b = _unit((one * np.uint32(0x9E3779B1) + two) >> np.uint32(16))
        half, rest = np.uint32(16), np.uint32(0xFFFF)
        r = -np.log(_unit(one >> half) * _unit(one & rest))
        c = -np.log(_unit(two >> half) * _unit(two & rest))
        t = np.floor(np.log(weight[at : at + len(h)])[:, None] / r + b)
        a = c * np.exp(-r * (t - b + 1))
        name = one + t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA77)
        # Positive floats order as their bits do; equal values go to the least name.
        key = a.view(np.uint32).astype(np.uint64) << np.uint64(32) | name
        lo = int(np.searchsorted(first, at, "right")) - 1
        hi = int(np.searchsorted(first, at + len(h), "left"))
        cuts = np.maximum(first[lo:hi] - at, 0)
        out[lo:hi] = np.minimum(out[lo:hi], np.minimum.reduceat(key, cuts, axis=0))
    return out.astype(np.uint32)


def band_keys(names: np.ndarray) -> np.ndarray:
    """A key for each band of every text; bands have no keys in common but by chance."""
    names = names.reshape(len(names), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), names.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + names[:, :, k])
    return key.view(np.int64)


def similarity(texts: list[bytes], others: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each text with the one at its side."""
    n = len(texts)
    h, t, times = shingles([*texts, *others])
    w = weights(h, times, idf).astype(np.float64)
    total = np.bincount(t, w, 2 * n)
    order = np.lexsort((h, t % n))
    h, pair, w = h[order], (t % n)[order], w[order]
    same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
    both = np.bincount(pair[1:][same], np.minimum(w[1:], w[:-1])[same], n)
    return both / np.maximum(total[:n] + total[n:] - both, 1e-9)


def all_similar(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every two texts (not of a text with itself)."""
    n = len(texts)
    h, t, times = shingles(texts)
    w = weights(h, times, idf).astype(np.float64)
    total = np.bincount(t, w, n)
    both = np.zeros((n, n))
    names, place, often = np.unique(h, return_inverse=True, return_counts=True)
    shared = often[place] > 1
    place, t, w = place[shared], t[shared], w[shared]
    order = np.argsort(place, kind="stable")
    place, t, w = place[order], t[order], w[order]
    # The least of two weights is the sum of the steps that both reach.
    column = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])]) if len(place) else place
    for step, reach in _steps(column, w):
        cells, which = np.unique(column[reach], return_inverse=True)
        for at in range(0, len(cells), 4096):
            own = (which >= at) & (which < at + 4096)
            table = np.zeros((n, min(4096, len(cells) - at)))
            table[t[reach][own], which[own] - at] = step[cells[which[own]]]
            both += table @ (table > 0).T
    return both / np.maximum(total[:, None] + total[None, :] - both, 1e-9)


def _steps(column: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rising weights of each column: the next step of every column, and the entries that reach it."""
    n = int(column.max(initial=-1)) + 1
    done = np.zeros(n)
    while True:
        above = w > done[column] + 1e-9
        if not above.any():
            return
        least = np.full(n, np.inf)
        np.minimum.at(least, column[above], w[above])
        step = np.where(np.isfinite(least), least - done, 0)
        yield step, above
        done = np.where(np.isfinite(least), least, done)


def sketches(docs: DataFrame, idf) -> DataFrame:
    """(n, same, keys) for rows (n, text): a digest of the words, and the keys of the bands.

    Both are null for a text without words.
    """

    def sketch(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_batches(t or b"" for t in values(batch.column("text"))):
                h, t, times = shingles(texts)
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else []
                keys: list = [None] * len(texts)
                if len(t):
                    found = band_keys(samples(h, weights(h, times, idf.value), first))
                    for i, row in zip(t[first], found.tolist(), strict=True):
                        keys[i] = row
                same = [
                    hashlib.sha256(b" ".join(words_of(text))).digest()[:16] if k else None
                    for text, k in zip(texts, keys, strict=True)
                ]
                yield pa.record_batch(
                    {
                        "n": batch.column("n")[at : at + len(texts)],
                        "same": pa.array(same, pa.binary()),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )
                at += len(texts)

    return docs.mapInArrow(sketch, "n long, same binary, keys array<long>")


def with_company(posts: DataFrame) -> DataFrame:
    """Posts with the number of texts that share a bucket with each text."""
    company = posts.groupBy("n").agg(F.sum("size").alias("company"))
    return posts.join(company, "n")


def star_links(posts: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Verified links (a, b) of every bucket's texts with its leader."""
    company = with_company(posts)
    best = F.max(F.struct("company", (-F.col("n")).alias("m")))
    leaders, _ = stored(company.groupBy("key").agg(best.alias("best")).select("key", (-F.col("best.m")).alias("a")))
    pairs = (
        posts.join(leaders, "key")
        .where("a != n")
        .select("a", F.col("n").alias("b"))
        .distinct()
    )

    def verify(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for left in in_batches(values(batch.column("left"))):
                own = batch.slice(at, len(left))
                similar = similarity(left, own.column("right").to_pylist(), idf.value) >= least
                yield own.select(["a", "b"]).filter(pa.array(similar))
                at += len(left)

    return (
        pairs.join(texts.select(F.col("n").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("n").alias("b"), F.col("text").alias("right")), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(verify, "a long, b long")
    )


def rest_links(posts: DataFrame, classes: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Verified links (a, b) between classes that still meet in a bucket.

    Buckets with the same texts are one. A bucket is cut into blocks of about BLOCK texts, and
    every two blocks are compared by a task of their own, which keeps no more links than it
    takes to join the classes it found similar.
    """
    own = posts.join(classes, "n", "left").select("key", "n", "size", F.coalesce("component", "n").alias("component"))
    buckets = (
        own.groupBy("key")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.first("size").alias("size"),
            F.sum(F.xxhash64("n").cast("decimal(20,0)")).alias("members"),
        )
        # Two texts have been compared already.
        .where("low != high AND size > 2")
        .groupBy("members", "size")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    )
    block = F.pmod(F.xxhash64("n", F.lit(1)), F.col("blocks"))
    members = own.drop("size").join(buckets, "key").withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = members.join(texts, "n").select("key", "n", "component", "block", "text", other)
    rows = rows.select(
        "n", "component", "block", "text",
        F.struct("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("task"),
    )

    def compare(key, table):
        rows = table.sort_by("n")
        n, component = rows.column("n").to_pylist(), rows.column("component").to_pylist()
        similar = all_similar(rows.column("text").to_pylist(), idf.value) >= least
        block = np.array(rows.column("block").to_pylist())
        if len(set(block.tolist())) > 1:  # each block with itself has a task of its own
            similar &= block[:, None] != block[None, :]
        root = {c: c for c in component}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
            a, b = top(component[i]), top(component[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((n[i], n[j]))
        return pa.table(
            {"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())}
        )

    return rows.groupBy("task").applyInArrow(compare, "a long, b long")


def _decided(docs: DataFrame, id_column: str, text_column: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows with numbers of their own, and what becomes of each number."""
    spark: SparkSession = docs.sparkSession
    base, _ = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")))
    texts = base.select("n", F.col("row").getField(text_column).cast("binary").alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(texts))
    known, _ = stored(sketches(texts, idf))
    # One row stands for all with the same words.
    firsts, _ = stored(known.where("same IS NOT NULL").groupBy("same").agg(F.min("n").alias("head")))
    posts = known.join(firsts, known.n == firsts["head"], "leftsemi").select("n", F.explode("keys").alias("key"))
    shared, shared_path = stored(posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    posts, posts_path = stored(posts.join(shared, "key").select("key", "n", "size"))
    drop(spark, shared_path)
    star, star_path = stored(star_links(posts, texts, idf, least))
    classes = components(star)
    rest = rest_links(posts, classes, texts, idf, least)
    links, links_path = stored(star.unionByName(rest))
    classes = components(links)
    for path in (posts_path, star_path, links_path):
        drop(spark, path)
    of_row = (
        known.select("n", "same")
        .join(firsts, "same", "left")
        .select("n", F.coalesce("head", "n").alias("head"))
        .join(classes.withColumnRenamed("n", "head"), "head", "left")
        .select("n", F.coalesce("component", "head").alias("component"))
    )
    named = base.select("n", F.col("row").getField(id_column).alias("id")).join(of_row, "n")
    # Read from tables, the firsts and the best leave Spark free to split the rows of a large class.
    best, best_path = stored(
        named.groupBy("component").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("best"),
            F.count(F.lit(1)).alias("class_size"),
        )
    )
    decided, _ = stored(
        named.join(best, "component").select(
            "n",
            F.col("best.id").alias("class_id"),
            "class_size",
            (F.col("n") == F.col("best.n")).alias("kept"),
        )
    )
    drop(spark, best_path)
    return base, decided


def mark(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: float = SIMILAR,
) -> DataFrame:
    """One row per document: ``row`` (its own columns), class_id, class_size and kept.

    A class is named by the least id in it, and the document with that id stays (a null id
    counts as larger than any; of rows with one id, the first read). Texts without words, null
    among them, are alone in their class. An empty table gives an empty result.
    """
    base, decided = _decided(docs, id_column, text_column, least)
    return base.join(decided, "n").select("row", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each class, with its own columns.

    A table of bits tells which rows may be among those to go; only these are shuffled, the
    others pass straight through.
    """
    base, decided = _decided(docs, id_column, text_column, SIMILAR)
    others = decided.where("NOT kept").select("n")
    bits = bits_of(others)

    @F.arrow_udf(BooleanType())
    def may_go(n: pa.Array) -> pa.Array:
        return pa.array(among(n.to_numpy(), bits))

    marked = base.withColumn("_may_go", may_go("n"))
    unsure = marked.where("_may_go").join(others, "n", "left_anti")
    return marked.where("NOT _may_go").unionByName(unsure).select("row.*")
