"""Spelling variants: words one edit apart, found by asymmetric chunks.

Two words are near if one inserted, deleted or replaced code point separates them. The shorter
word contributes two disjoint chunks, each half as long as itself; the longer one contributes
its grams of that length, at the places a chunk can have there. One edit leaves at least one
chunk whole, moved by one place at most. That half alone would bring all words with a common
ending together, so the rest of the word, which holds the edit, is cut into two chunks in the
same way: words meet only when they share three quarters of the shorter one, and every meeting
is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabtrace.llm.common import drop, stored

LETTERS = "[a-zÀ-ÿ]"
LEAST_CHARS = 5
LEAST_COUNT = 3
# A variant's form occurs at least so many times as often as the variant.
DOMINANCE = 2
# One in so many words of a text gets an artificial slip.
SLIPS = 97

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 1
) -> DataFrame:
    """(doc, run): the maximal runs of letters of every text, A-Z lower-cased.

    Runs of fewer than ``least_chars`` letters are left out. ``doc`` is the id as text, empty for a null id. A null text has no runs; repeated rows
    count as often as they occur.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), _UPPER, _LOWER)
    return docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"),
    )


def with_slips(found: DataFrame, one_in: int = SLIPS) -> DataFrame:
    """(word): every run, with a letter left out where the checksum of ``doc:run`` says so."""
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    slipped = found.withColumns({"h": h, "at": (h % F.char_length("run")).cast("int")})
    cut = F.expr("concat(substring(run, 1, at), substring(run, at + 2))")
    return slipped.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words of some length that occur often enough."""
    long_enough = words.where(F.char_length("word") >= least_chars)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# A word is cut in halves and the half with the edit in halves again, so two chunks stay whole:
# the left or the right half of the word, and the left or the right one of the rest. Each is
# (start, length), told by the word's ``size``, the chunk lengths ``a`` and ``b`` and the rest.
_WHOLE = [
    [("1", "a"), ("1 + a", "b")],
    [("1", "a"), ("1 + size - b", "b")],
    [("1 + size - a", "a"), ("1", "b")],
    [("1 + size - a", "a"), ("1 + size - a - b", "b")],
]


def _chunked(words: DataFrame, shorter_by: int) -> DataFrame:
    """(word, n, a, b, side, key): what a word shares with a near one that is shorter by 0 or 1.

    ``a`` is half of the shorter word, ``b`` half of what is left of it.
    """
    sized = words.withColumn("size", F.char_length("word"))
    halved = sized.withColumn("a", F.expr(f"(size - {shorter_by}) DIV 2"))
    cut = halved.withColumn("b", F.expr(f"(size - {shorter_by} - a) DIV 2"))
    keys = [
        f"concat(size - {shorter_by}, '{side}:', " + ", ':', ".join(f"substring(word, {at}, {n})" for at, n in whole) + ")"
        for side, whole in zip("abcd", _WHOLE, strict=True)
    ]
    return cut.select("word", "n", "a", "b", F.posexplode(F.expr(f"array({', '.join(keys)})")).alias("side", "key"))


def _first_meeting() -> Column:
    """Whether a pair that met on one side did not meet on an earlier one, too."""

    def same_left(n: str) -> str:
        return f"left(word, {n}) = left(other, {n})"

    def same_right(n: str) -> str:
        return f"right(word, {n}) = right(other, {n})"

    met = [same_left("a + b"), f"{same_left('a')} AND {same_right('b')}", f"{same_right('a')} AND {same_left('b')}"]
    return F.expr(
        f"CASE side WHEN 0 THEN true WHEN 1 THEN NOT ({met[0]}) WHEN 2 THEN NOT ({met[0]} OR {met[1]}) "
        f"ELSE NOT ({met[0]} OR {met[1]} OR {met[2]}) END"
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of near words of a vocabulary, once."""
    chunks = _chunked(words, 0)
    out = None
    for shorter_by in (0, 1):
        grams = _chunked(words, shorter_by).select(
            F.col("word").alias("other"), F.col("n").alias("other_n"), "side", "key"
        )
        met = chunks.join(grams, ["key", "side"])
        if not shorter_by:
            met = met.where("word < other")
        one_edit = met.where(F.levenshtein("word", "other", 1) == 1).where(_first_meeting())
        pairs = one_edit.select("word", "n", "other", "other_n")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def forms(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of a vocabulary.

    The form is the near word with the largest n (of several, the first in code-point order)
    if that is at least ``dominance`` times the word's own; else null.
    """
    pairs = near_pairs(words)
    none = F.lit(None)
    both = (
        pairs.select("word", none.cast("long").alias("n"), "other", "other_n")
        .unionByName(pairs.select(F.col("other").alias("word"), none.cast("long").alias("n"),
                                  F.col("word").alias("other"), F.col("n").alias("other_n")))
        .unionByName(words.select("word", "n", none.cast("string").alias("other"), none.cast("long").alias("other_n")))
    )
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other")))
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    dominant = -F.col("best.less") >= F.col("n") * dominance
    return found.select(
        "word", "n", "n_near",
        F.when(dominant, F.col("best.other")).alias("form"),
        F.when(dominant, -F.col("best.less")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the last of its forms.

    A form occurs more often than its word, so the way ends; every round doubles the steps
    taken and is written to the shared folder.
    """
    links, path = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        new, new_path = stored(further)
        moved = new.where("moved").limit(1).count()
        drop(found.sparkSession, path)
        links, path = new.select("word", "root"), new_path
        if not moved:
            return links


def variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    ``words`` has each word once; null words are left out. Other columns don't matter. An
    empty vocabulary gives an empty result.
    """
    kept, path = stored(words.where("word IS NOT NULL").select("word", "n"))
    found, _ = stored(forms(kept, dominance))
    drop(words.sparkSession, path)
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
