"""Chat logs folded into final messages and rendered as training text.

A log has one row per event: conv_id, seq, turn, event, role, text. Events of a turn apply in
the order of seq (then of the kinds below, role and text):

* ``start`` opens a message; a second one opens another message of the same turn;
* ``delta`` appends its text to the turn's latest message;
* ``edit`` replaces the message's text; later deltas append to the edited text;
* ``regenerate`` throws the message's text away; its own text and later deltas are the new one.

Other kinds count as deltas, and an event before any start opens a message itself. A message
has the role of its first event that names one; a null role or text counts as empty.

A turn is rendered as OPEN role SEPARATOR text CLOSE. Inside role and text, a backslash is put
after the first character of every control string, and one more where backslashes stand there
already, so reading back takes exactly one away.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEPARATOR, CLOSE = "[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"
KINDS = ("start", "delta", "edit", "regenerate")

# Every control string begins with one of these characters and has none of them further on.
_HEAD = "([<\\[])"
_TAIL = "(" + "|".join(re.escape(c[1:]) for c in (OPEN, SEPARATOR, CLOSE)) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_HEAD}(\\*){_TAIL}", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_HEAD}\\(\\*){_TAIL}", "$1$2$3")


def log_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log in which every row starts a message."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.lit("start").alias("event"), "role", "text"
    )


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, message (its number in the turn), role, text.

    Only the events of one turn meet in a task; a conversation's turns are spread.
    """
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("event")), F.lit(0))
    rows = log.select(
        "conv_id", "turn", "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "message": F.count_if(F.col("kind") == 1).over(so_far),
            "version": F.count_if(F.col("kind") >= 3).over(so_far),
        }
    )
    message = Window.partitionBy("conv_id", "turn", "message")
    rows = rows.withColumns(
        {
            "latest": F.max("version").over(message),
            "named": F.min(F.when(F.col("role").isNotNull(), F.struct("place", "role"))).over(message),
        }
    )
    part = F.when(F.col("version") == F.col("latest"), F.struct("place", "text"))
    return rows.groupBy("conv_id", "turn", "message").agg(
        F.coalesce(F.first("named.role"), F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss.

    ``loss`` marks the text to learn: for each turn the first character within the turn's
    rendering (from 0) and the number of characters, 0 for turns of other roles. Turns stand
    in order of turn, then message; their pieces are made before they are brought together.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEPARATOR))
    body = escape(F.col("text"))
    learned = F.when(F.col("role") == LEARNED_ROLE, F.char_length(body)).otherwise(0)
    pieces = messages.select(
        "conv_id",
        F.struct(
            "turn",
            "message",
            F.concat(head, body, F.lit(CLOSE)).alias("piece"),
            F.struct(F.char_length(head).alias("start"), learned.alias("length")).alias("span"),
        ).alias("p"),
    )
    turns = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("turns"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each) and learned (the texts under the loss mask)."""
    pieces = F.split("formatted", re.escape(CLOSE), -1)
    pieces = F.slice(pieces, 1, F.array_size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(F.substring(piece, len(OPEN) + 1, F.char_length(piece)), re.escape(SEPARATOR), 2)
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    def under_mask(piece: Column, span: Column) -> Column:
        return unescape(F.substring(piece, span["start"] + 1, span["length"]))

    return rendered.select("conv_id", "formatted", "loss", pieces.alias("pieces")).select(
        "conv_id",
        "formatted",
        F.transform("pieces", turn).alias("turns"),
        F.zip_with("pieces", "loss", under_mask).alias("learned"),
    )


def format_chats(log: DataFrame) -> DataFrame:
    """A log folded and rendered; an empty log has no conversations."""
    return render(fold(log))
