"""Documents with every awkward case, and columns whose names the operators use themselves."""

LONG = " ".join(f"word{i % 977} of{i}" for i in range(40_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60)) + "."

ROWS = [
    (0, None),
    (1, ""),
    (2, " \n ... \n\n"),
    (3, "One two three four five six seven eight."),
    (3, "One two three four five six seven eight."),
    (4, "ONE two three four five six seven eight."),
    (5, "ÉCOLE été 中文 <|endoftext|> é \U0001f600"),
    (6, "école été 中文 <|endoftext|> é \U0001f600"),
    (7, LONG),
    (8, LONG + " end"),
    (9, "Before it.\n" + PASSAGE + " And after.\nBefore it."),
    (10, PASSAGE + "\nSomething else altogether here, in nine words only."),
    (None, "One two three four five six seven eight."),
    (None, None),
    (11, "a"),
]

CLASHING = ["row", "n", "id", "digest", "kept", "keep_id", "number", "lang", "score", "units", "left", "component"]


def documents(spark, rows=ROWS):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], schema)


def empty(spark):
    return documents(spark, [])
