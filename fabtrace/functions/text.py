"""Readable one-line texts for lot transactions.

Both builders take the columns they need by keyword, so they work on any source whose
columns can be mapped.  ``oracle_empty_is_null=True`` gives what a database that treats the
empty string as null really returns: ``TRIM(c) != ''`` is then never true and no comment is
ever appended.  The default appends every non-blank comment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording shown for each transaction code.
BY_OPERATOR = {
    "MVIN": "Lot moved in logged by ",
    "MVOU": "Lot moved out logged by ",
    "TRST": "Lot moved to/from store logged by ",
    "SLTA": "Lotattribute set logged by ",
    "RLLT": "Lot released logged by ",
    "HLLT": "Lot hold logged by ",
}
NO_OPERATOR = {
    "COMM": "Lot comment logged by",
    "1RCL": "Lot moved to entity logged by",
    "EDC": "Transaction logged logged by",
    "JC": "Transaction logged logged by",
    "TASK": "Transaction logged logged by",
}
NO_OPERATOR_MES = {
    "ALFG": "Transaction logged logged by",
    "EI": "EI comment logged by",
}
OPERATOR_ONLY_MES = {
    "2PSO": "SIP moved out logged by ",
    "2PSI": "SIP moved in logged by ",
    "2CRT": "Lot created by ",
    "2SCR": "Lot scrapped by ",
}
SPECIAL_RUN_MES = {"2SON": " Special Run END", "2SIN": " Special Run START"}
HOLD_SET = "Lot set on HOLD by "
HOLD_RELEASED = "Hold released by "
RESERVED = "LOT WAS RESERVED FOR ENTITY "
RESERVED_FROM = "   FROM OPERAT. "
RESERVATION_CANCELED = "Reservation canceled."
ALF_STOP = "ALF Stop logged by "
NOBODY = "SYSTEM"
COMMENT_SEPARATOR = "\x14"


def joined(*parts: Column | str) -> Column:
    """Concatenation in which a null part counts as empty."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def trimmed_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_comment(c: Column) -> Column:
    """Comment with each ``;`` replaced by the control character DC4."""
    return F.replace(c, F.lit(";"), F.lit(COMMENT_SEPARATOR))


# Text of a number, and the exponents beyond which it is none for the source.
NUMBER = r"^\s*([+-]?)(?=\.?[0-9])([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,3}))?\s*$"
LARGEST_EXPONENT = 130


def number_text(c: Column) -> Column:
    """Shortest decimal text of a number held as text; null when it is not a number.

    The text itself is rewritten, so no digit is lost, however many there are.
    """
    sign, before, after, exponent = (F.regexp_extract(c, NUMBER, i) for i in range(1, 5))
    power = F.coalesce(F.nullif(exponent, F.lit("")).try_cast("int"), F.lit(0))
    digits = F.concat(before, after)
    point = F.char_length(before) + power
    # Zeros the point moves across, none if it stays within the digits.
    padded = F.concat(
        F.repeat(F.lit("0"), F.greatest(F.lit(0), -point)),
        digits,
        F.repeat(F.lit("0"), F.greatest(F.lit(0), point - F.char_length(digits))),
    )
    cut = F.greatest(F.lit(0), point)
    whole = F.ltrim(F.substring(padded, F.lit(1), cut), F.lit("0"))
    part = F.rtrim(F.substring(padded, cut + 1, F.char_length(padded)), F.lit("0"))
    shown = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    text = F.when(shown == "", "0").otherwise(F.concat(F.when(sign == "-", "-").otherwise(""), shown))
    return F.when(c.rlike(NUMBER) & (F.abs(power) <= LARGEST_EXPONENT), text)


def appended(c: Column, oracle_empty_is_null: bool, shown: Column | None = None) -> Column:
    """A new line and ``shown`` (or ``c``) when ``c`` is non-blank, else nothing."""
    if oracle_empty_is_null:
        return F.lit("")
    return F.when(F.trim(c) != "", joined("\n", c if shown is None else shown)).otherwise("")


def by_code(code: Column, texts: dict[str, Column], otherwise: Column) -> Column:
    """The text of a code; ``otherwise`` for codes without one."""
    chain = F
    for known, text in texts.items():
        chain = chain.when(code == known, text)
    return chain.otherwise(otherwise)


def _fallback_text(code: Column, who: Column, comment: Column) -> Column:
    return F.coalesce(trimmed_or_null(comment), joined("(", code, " by ", who, ")"))


def mes_text(
    transaction: Column,
    operator_id: Column,
    comment: Column,
    actual_entity: Column,
    is_reserved: Column,
    is_reserved_machine: Column,
    is_reserved_operator: Column,
    quantity: Column,
    hold_code: Column,
    hold_comment: Column,
    oracle_empty_is_null: bool = False,
    hold_comment_length: int | None = None,
) -> Column:
    """Text of a transaction of the execution-system history.

    The hold comment is shown whole, or as many characters of it as ``hold_comment_length``.
    """
    who = F.coalesce(operator_id, F.lit(NOBODY))
    plus_comment = appended(comment, oracle_empty_is_null)
    shown = hold_comment if hold_comment_length is None else F.substring(hold_comment, 1, hold_comment_length)
    plus_hold = appended(hold_comment, oracle_empty_is_null, shown)
    special_run = {
        code: joined(
            operator_id,
            text,
            F.when(quantity.isNotNull(), joined(" /Wafer: ", number_text(quantity))),
            F.when(actual_entity.isNotNull(), joined(" /Entity: ", actual_entity)),
        )
        for code, text in SPECIAL_RUN_MES.items()
    }
    texts = {
        "2RSV": F.when(
            is_reserved == "Y",
            joined(
                RESERVED,
                F.coalesce(is_reserved_machine, actual_entity),
                RESERVED_FROM,
                F.coalesce(is_reserved_operator, operator_id),
            ),
        ).otherwise(RESERVATION_CANCELED),
        **special_run,
        **{k: joined(v, who) for k, v in OPERATOR_ONLY_MES.items()},
        **{k: joined(v, who, plus_comment) for k, v in BY_OPERATOR.items()},
        **{k: joined(v, plus_comment) for k, v in (NO_OPERATOR | NO_OPERATOR_MES).items()},
        "2SHL": F.coalesce(trimmed_or_null(comment), joined(ALF_STOP, who)),
        "2HLD": joined(
            HOLD_SET, who, F.when(hold_code.isNotNull(), joined(" | Code: ", hold_code)), plus_hold
        ),
        "2HRL": joined(HOLD_RELEASED, who, plus_hold),
    }
    return by_code(transaction, texts, _fallback_text(transaction, who, comment))


def fallback_text(
    transcode: Column, operator: Column, comment: Column, oracle_empty_is_null: bool = False
) -> Column:
    """Text of a transaction of the fallback histories."""
    who = F.coalesce(operator, F.lit(NOBODY))
    cleaned = clean_comment(comment)
    plus_comment = appended(cleaned, oracle_empty_is_null)
    texts = {
        **{
            k: joined(v, who, plus_comment)
            for k, v in (BY_OPERATOR | {"2HLD": HOLD_SET, "2HRL": HOLD_RELEASED}).items()
        },
        **{k: joined(v, plus_comment) for k, v in NO_OPERATOR.items()},
    }
    return by_code(transcode, texts, _fallback_text(transcode, who, cleaned))
