"""Passages that occur again, found by hashing lines or paragraphs, and removed.

A text is cut at line feeds (``line``), at blank lines (``paragraph``), or at line feeds and
sentence ends (``sentence``). Every unit has a digest of its words; units are grouped by digest
over all documents, the one in the first place (least document id, then first in the text)
stays, and all others are removed. What stays keeps its offsets in the original text. Units
without words say nothing and stay.

Two lengths can limit this. Units of fewer than ``least_words`` words get a digest that also covers
the units before them back to the last longer one, so they go only where they follow the same
text. And only runs of consecutive repeated units with ``least_passage`` words in all go; units
without words don't break a run. Both are 1 by default, which removes every later occurrence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from fabtrace.llm.common import Batches, drop, stored, values
from fabtrace.llm.decontaminate import words

LEAST_WORDS = 1
LEAST_PASSAGE = 1
# Words from which removed units that follow each other are counted as a passage.
PASSAGE = 30
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]")
CUTS = {
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n[ \t\r]*\n\s*"),
    "sentence": re.compile(r"(?<=[.!?]) +|\n+"),
}

_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
LEFT = StructType(
    [
        StructField("n_units", LongType()),
        StructField("n_removed", LongType()),
        StructField("removed_words", LongType()),
        StructField("in_passages", LongType()),
        StructField("kept_in", ArrayType(LongType())),
        StructField("kept_text", StringType()),
        StructField("kept", ArrayType(_SPAN)),
    ]
)


def units(text: str, cut: str = "sentence") -> list[tuple[int, int]]:
    """Start and end of every unit, separators left out; empty ones aren't units."""
    out, at = [], 0
    for found in CUTS[cut].finditer(text):
        if found.start() > at:
            out.append((at, found.start()))
        at = found.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def digests(text: str, cut: str = "sentence", least: int = LEAST_WORDS) -> Iterator[tuple[int, bytes, int]]:
    """Number, digest and words of every unit that can be removed."""
    before = None
    for number, (start, end) in enumerate(units(text, cut)):
        own = words(text[start:end].encode())
        if not own:
            continue
        joined = b" ".join(own)
        if len(own) >= least:
            before = hashlib.blake2b(joined, digest_size=16).digest()
        elif before is not None:
            before = hashlib.blake2b(joined, digest_size=16, key=before).digest()
        else:
            continue
        yield number, before, len(own)


def _unit_rows(texts: DataFrame, cut: str, least: int) -> DataFrame:
    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            ids, all_n = batch.column("id").to_pylist(), batch.column("n").to_pylist()
            for i, n, text in zip(ids, all_n, values(batch.column("text")), strict=True):
                for number, digest, size in digests(text or "", cut, least):
                    for column, value in zip(out, (i, n, number, digest, size), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int32()),
                    pa.array(out[3], pa.binary()),
                    pa.array(out[4], pa.int32()),
                ],
                ["id", "n", "unit", "digest", "words"],
            )

    return texts.mapInArrow(rows, "id long, n long, unit int, digest binary, words int")


def passages(repeated: list[dict], least: int, wordless: Callable[[int], bool] = lambda _: False) -> list[dict]:
    """The units of runs of consecutive units that have ``least`` words or more in all."""
    out, run = [], []
    for unit in [*sorted(repeated, key=lambda u: u["unit"]), None]:
        if run and (unit is None or not all(map(wordless, range(run[-1]["unit"] + 1, unit["unit"])))):
            if sum(u["words"] for u in run) >= least:
                out += run
            run = []
        run.append(unit)
    return out


def mark(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    cut: str = "sentence",
    least_words: int = LEAST_WORDS,
    least_passage: int = LEAST_PASSAGE,
) -> DataFrame:
    """One row per document: ``row`` (its own columns) and what is left of its text.

    n_units, n_removed, removed_words; in_passages, how many of the removed units stand in runs
    of PASSAGE words or more; kept_in, the ids of the documents that keep what was removed here,
    in order, null last; kept_text, the rest of the text with the separators that stood
    before each unit; kept, the (start, end) in the original of each unit that stays. Ids are
    whole numbers; a null one ranks last, and of rows with one id the first read ranks first.
    Null and empty texts have no units.
    """
    base, _ = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")))
    texts = base.select(
        F.col("row").getField(id_column).cast("long").alias("id"),
        "n",
        F.col("row").getField(text_column).alias("text"),
    )
    found, found_path = stored(_unit_rows(texts, cut, least_words))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "n", "unit")
    firsts, _ = stored(
        found.groupBy("digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select("digest", "first")
    )
    # Read from a table, the firsts leave Spark free to split the units of a frequent digest.
    repeated, _ = stored(
        found.join(firsts, "digest")
        .where((F.col("n") != F.col("first.n")) | (F.col("unit") != F.col("first.unit")))
        .groupBy("n")
        .agg(F.collect_list(F.struct("unit", "words", F.col("first.id").alias("first"))).alias("repeated"))
    )
    drop(docs.sparkSession, found_path)
    strip = _strip(cut, least_passage)
    none = F.array().cast("array<struct<unit:int,words:int,first:bigint>>")
    left = strip(F.col("row").getField(text_column), F.coalesce("repeated", none))
    return base.join(repeated, "n", "left").withColumn("left", left).select("row", "left.*")


def _strip(cut: str, least: int):
    """From a text and its units that occur elsewhere first: what stays of it."""

    @F.arrow_udf(LEFT)
    def strip(texts: pa.Array, repeated: pa.Array) -> pa.Array:
        counts, removed, sizes, inside, sources, kept_texts, kept = [], [], [], [], [], [], []
        for text, again in zip(values(texts), values(repeated), strict=True):
            found = units(text or "", cut)

            def wordless(i: int, text=text, found=found) -> bool:
                return not _WORD.search(text, *found[i])

            again = passages(again, least, wordless)
            removed.append(len(again))
            sizes.append(sum(u["words"] for u in again))
            inside.append(len(passages(again, PASSAGE, wordless)))
            sources.append(sorted({u["first"] for u in again}, key=lambda i: (i is None, i or 0)))
            gone = {u["unit"] for u in again}
            stay = [(i, *u) for i, u in enumerate(found) if i not in gone]
            counts.append(len(found))
            kept.append([{"start": a, "end": b} for _, a, b in stay])
            # Each unit but the first brings the separator that stood before it.
            parts = [text[found[i - 1][1] if k and i else a : b] for k, (i, a, b) in enumerate(stay)]
            kept_texts.append("".join(parts) if gone else text)
        return pa.StructArray.from_arrays(
            [
                *(pa.array(x, pa.int64()) for x in (counts, removed, sizes, inside)),
                pa.array(sources, pa.list_(pa.int64())),
                pa.array(kept_texts, pa.string()),
                pa.array(kept, _SPANS),
            ],
            LEFT.fieldNames(),
        )

    return strip
