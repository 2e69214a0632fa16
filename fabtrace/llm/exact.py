"""Exact deduplication: two Bloom passes, so that only rows that may repeat are shuffled.

The first pass sets the cells of every digest in an array of cells that count to two. A digest
is possibly repeated if each of its cells was set twice or more; no repeated digest is missed.
The second pass keeps all other rows as they are, without a shuffle, and groups the possibly
repeated ones by their whole digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from fabtrace.llm.common import Batches, gather, stored

CELLS_PER_ROW = 8
# 64 MB for each of the two bit arrays a task fills; more rows take more passes, each over
# its own range of digests.
MOST_CELLS = 1 << 29


@F.arrow_udf(BinaryType())
def text_digest(texts: pa.Array) -> pa.Array:
    """SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty."""
    return pa.array(
        [hashlib.sha256((t or b"").lower()).digest() for t in texts.to_pylist()], pa.binary()
    )


def _cells(digests: pa.Array, cells: int) -> np.ndarray:
    """The two cells of each digest."""
    words = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(len(digests), 4)
    return (words[:, 1:3] & np.uint64(cells - 1)).astype(np.int64)


def _set(bits: np.ndarray, cells: np.ndarray) -> None:
    np.bitwise_or.at(bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))


def _test(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[0] | b[0], a[1] | b[1] | (a[0] & b[0])])


def repeat_filter(digests: DataFrame, rows: int, most_cells: int = MOST_CELLS) -> tuple[np.ndarray, int]:
    """Bits of the cells that two or more rows set, and the number of cells."""
    cells = min(most_cells, max(1 << 13, 1 << (CELLS_PER_ROW * max(rows, 1) - 1).bit_length()))

    def fill(batches: Batches) -> np.ndarray:
        bits = np.zeros((2, cells // 8), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = _cells(batch.column(0), cells)
            # A digest with both hashes on one cell sets it once.
            flat = np.concatenate([pair[:, 0], pair[pair[:, 0] != pair[:, 1], 1]])
            found, times = np.unique(flat, return_counts=True)
            _set(bits[1], found[(times > 1) | _test(bits[0], found)])
            _set(bits[0], found)
        return bits

    return gather(digests, fill, cells // 8, np.uint8, 2, _combine)[1], cells


def may_repeat(digest: Column, bits: np.ndarray, cells: int, spark) -> Column:
    """Whether another row may have the same digest."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf(BooleanType())
    def test(digests: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in digests:
            pair = _cells(batch, cells) if len(batch) else np.zeros((0, 2), np.int64)
            yield pa.array(_test(shared.value, pair).all(axis=1))

    return test(digest)


def mark(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: list[str] | None = None,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """One row per document with what becomes of it.

    Columns: ``row`` (a struct of the columns in ``carry``, by default all, so no name can
    clash), keep_id, group_size, kept and text_sha256. Texts are equal when identical after
    lower-casing A-Z; null counts as empty. Of equal texts the row with the largest id stays
    (a null id is the smallest); of rows that also share the id, the first one read. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in (carry if carry is not None else docs.columns)])
    table, _ = stored(
        docs.select(
            row.alias("row"),
            F.col(f"`{id_column}`").alias("id"),
            text_digest(F.col(f"`{text_column}`").cast("binary")).alias("digest"),
            F.monotonically_increasing_id().alias("number"),
        )
    )
    rows = table.count()
    passes = max(1, -(-rows * CELLS_PER_ROW // most_cells))
    # The range of a digest comes from other bits than its cells.
    turn = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % passes
    out = None
    for k in range(passes):
        own = table if passes == 1 else table.where(turn == k)
        bits, cells = repeat_filter(own.select("digest"), -(-rows // passes), most_cells)
        marked = own.withColumn("_again", may_repeat(F.col("digest"), bits, cells, spark))
        part = _alone(marked.where(~F.col("_again"))).unionByName(_grouped(marked.where("_again")))
        out = part if out is None else out.unionByName(part)
    return out


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select(
        "row",
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    groups, _ = stored(
        rows.groupBy("digest").agg(
            F.max(F.struct("id", (-F.col("number")).alias("n"))).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )
    # Read from a table, the groups leave Spark free to split the rows of a large one.
    return rows.join(groups, "digest").select(
        "row",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (-F.col("number") == F.col("best.n")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    return mark(docs, id_column, text_column).where("kept").select("row.*")
