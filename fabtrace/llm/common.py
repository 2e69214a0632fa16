"""What several corpus operators share."""

from __future__ import annotations

import contextlib
import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabtrace.sources.scratch import new_path

# Cells in a piece of a gathered array, and pieces merged by one task at a time.
PIECE = 1 << 15
FAN_IN = 32
# Code points handled at once by the vectorised operators; only memory depends on it.
BATCH_CHARS = 1 << 18

Batches = Iterator[pa.RecordBatch]


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def gather(
    df: DataFrame,
    fill: Callable[[Batches], np.ndarray],
    cells: int,
    dtype: type,
    rows: int = 1,
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = add,
) -> np.ndarray:
    """One (rows, cells) array filled from all rows of ``df``.

    Each task fills an array of its own and sends the pieces that are not empty. Pieces are
    combined in a tree, FAN_IN at a time, so a merge never holds more than FAN_IN pieces
    however many tasks there are. Only the result, whose size is fixed by ``cells``, comes
    to the driver, compressed and in one job.
    """

    def emit(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from pieces_of(fill(batches).reshape(rows, cells))

    return combined(df.mapInArrow(emit, PIECES), df.rdd.getNumPartitions(), cells, dtype, rows, combine)


PIECES = "piece long, part long, payload binary"


def pieces_of(filled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's array that are not empty."""
    part = TaskContext.get().partitionId()
    for at in range(0, filled.shape[1], PIECE):
        piece = filled[:, at : at + PIECE]
        if piece.any():
            yield _packed(at // PIECE, part, piece)


def combined(
    parts: DataFrame,
    left: int,
    cells: int,
    dtype: type,
    rows: int = 1,
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = add,
) -> np.ndarray:
    """The (rows, cells) array that the pieces of ``left`` tasks make together; see ``gather``."""

    def merge(key, pieces):
        total = None
        for payload in pieces.column("payload").to_pylist():
            piece = np.frombuffer(zlib.decompress(payload), dtype).reshape(rows, -1)
            total = piece if total is None else combine(total, piece)
        return pa.Table.from_batches([_packed(key[0].as_py(), key[1].as_py(), total)])

    while left > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = parts.groupBy("piece", "part").applyInArrow(merge, PIECES)
        left = -(-left // FAN_IN)
    out = np.zeros((rows, cells), dtype)
    # In one job: an iterator would run a job for each partition, however few hold a piece.
    for row in parts.select("piece", "payload").collect():
        piece = np.frombuffer(zlib.decompress(bytes(row.payload)), dtype).reshape(rows, -1)
        at = row.piece * PIECE
        out[:, at : at + piece.shape[1]] = piece
    return out


def _packed(piece: int, part: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "piece": pa.array([piece], pa.int64()),
            "part": pa.array([part], pa.int64()),
            "payload": pa.array([zlib.compress(np.ascontiguousarray(cells).tobytes(), 1)], pa.binary()),
        }
    )


def values(column: pa.Array) -> Iterator:
    """The values of a column as Python objects, a few hundred at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def in_batches(texts: Iterable, most: int = BATCH_CHARS) -> Iterator[list]:
    """Consecutive texts, as many as fit in ``most`` characters (one at least)."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def flat(lists: Iterable[Iterable]) -> list:
    return list(itertools.chain.from_iterable(lists))


_recorded: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables stored meanwhile, for ``drop`` once their results are saved."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


# Shuffle files go when the query that wrote them is done, not when the driver next collects garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, free: bool = False) -> tuple[DataFrame, str]:
    """The same rows in a table of the shared folder, and its path for ``drop``.

    With ``free`` the shuffles of this query are removed from disk once the table is written.
    """
    path = new_path(df.sparkSession, "table")
    for paths in _recorded:
        paths.append(path)
    before = df.sparkSession.conf.get(_FREE, "false")
    df.sparkSession.conf.set(_FREE, "true" if free else before)
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set(_FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    """Documents nothing is learned from: the checksum of the id as text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
