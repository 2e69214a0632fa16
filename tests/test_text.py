import pytest
from pyspark.sql import functions as F

from fabtrace.functions import display, text
from fabtrace.operators import history
from fabtrace.sources import schemas
from tests.helpers import at, frame, rows_of

FULL = {
    "operator_id": "OP1", "commenttext": " note ", "actual_entity": "EQ1", "is_reserved": "Y",
    "is_reserved_machine": None, "is_reserved_operator": "RO", "quantity_1": "025.50",
    "hold_code": "H1", "hold_comment": "x" * 600,
}

MES = {
    "2RSV": "LOT WAS RESERVED FOR ENTITY EQ1   FROM OPERAT. RO",
    "2SON": "OP1 Special Run END /Wafer: 25.5 /Entity: EQ1",
    "2SIN": "OP1 Special Run START /Wafer: 25.5 /Entity: EQ1",
    "2PSO": "SIP moved out logged by OP1",
    "2PSI": "SIP moved in logged by OP1",
    "MVIN": "Lot moved in logged by OP1\n note ",
    "MVOU": "Lot moved out logged by OP1\n note ",
    "TRST": "Lot moved to/from store logged by OP1\n note ",
    "SLTA": "Lotattribute set logged by OP1\n note ",
    "COMM": "Lot comment logged by\n note ",
    "RLLT": "Lot released logged by OP1\n note ",
    "HLLT": "Lot hold logged by OP1\n note ",
    "1RCL": "Lot moved to entity logged by\n note ",
    "ALFG": "Transaction logged logged by\n note ",
    "2SHL": "note",
    "2HLD": "Lot set on HOLD by OP1 | Code: H1\n" + "x" * 600,
    "2HRL": "Hold released by OP1\n" + "x" * 600,
    "EI": "EI comment logged by\n note ",
    "EDC": "Transaction logged logged by\n note ",
    "JC": "Transaction logged logged by\n note ",
    "TASK": "Transaction logged logged by\n note ",
    "2CRT": "Lot created by OP1",
    "2SCR": "Lot scrapped by OP1",
    "ZZZZ": "note",
}
BLANK = {
    "2RSV": "Reservation canceled.",
    "2SON": " Special Run END",
    "2SHL": "ALF Stop logged by SYSTEM",
    "2HLD": "Lot set on HOLD by SYSTEM",
    "MVIN": "Lot moved in logged by SYSTEM",
    "COMM": "Lot comment logged by",
    "ZZZZ": "(ZZZZ by SYSTEM)",
}


def mes(spark, values, codes):
    rows = [values | {"transaction": c, "trans_timestamp": at(0)} for c in codes]
    return frame(spark, schemas.HISTORY_MES, rows)


def test_mes_texts(spark):
    got = rows_of(history.mes_rows(mes(spark, FULL, MES)), "TRANSACTION", "TEXT")
    assert got == {(k, v): 1 for k, v in MES.items()}


def test_mes_texts_without_values(spark):
    got = rows_of(history.mes_rows(mes(spark, {"commenttext": "  "}, BLANK)), "TRANSACTION", "TEXT")
    assert got == {(k, v): 1 for k, v in BLANK.items()}


def test_literal_mode_appends_no_comment(spark):
    got = rows_of(history.mes_rows(mes(spark, FULL, MES), oracle_empty_is_null=True), "TRANSACTION", "TEXT")
    assert got == {(k, v.split("\n")[0]): 1 for k, v in MES.items()}


def test_fallback_texts(spark):
    codes = ["MVOU", "2HLD", "EDC", "ZZZZ"]
    rows = [
        {"transcode": c, "operator": "OP1", "transaction_comment": "a;b", "time_stamp": at(0)} for c in codes
    ] + [{"transcode": "2HRL", "time_stamp": at(0), "transaction_comment": " "}]
    got = rows_of(
        history.fallback_rows(frame(spark, schemas.HISTORY_FALLBACK, rows)), "TRANSACTION", "COMMENTTEXT", "TEXT"
    )
    assert got == {
        ("MVOU", "a\x14b", "Lot moved out logged by OP1\na\x14b"): 1,
        ("2HLD", "a\x14b", "Lot set on HOLD by OP1\na\x14b"): 1,
        ("EDC", "a\x14b", "Transaction logged logged by\na\x14b"): 1,
        ("ZZZZ", "a\x14b", "a\x14b"): 1,
        ("2HRL", " ", "Hold released by SYSTEM"): 1,
    }


@pytest.mark.parametrize(
    "given, shown",
    [("025", "25"), ("25.50", "25.5"), ("100", "100"), ("0.50", ".5"), ("-0.5", "-.5"), ("0", "0"), ("abc", None),
     ("1" * 60 + "." + "0" * 30 + "10", "1" * 60 + "." + "0" * 30 + "1"), ("-0.00", "0"), ("+7.", "7"), (".5", ".5"),
     (" 12 ", "12"), ("1.5e3", "1500"), ("12.5E-4", ".00125"), ("-1e2", "-100"), ("123.45e1", "1234.5"), ("0e9", "0"),
     ("1e131", None), ("1e", None), (".", None), ("", None), ("1 2", None), ("--1", None), (None, None)],
)
def test_number_text(spark, given, shown):
    df = spark.createDataFrame([(given,)], "q string")
    assert df.select(text.number_text(F.col("q"))).first()[0] == shown


def test_deltas(spark):
    values = ["-3", "0", "2.25", "0.03125", "0.09375", "0.00015", "oops", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    c = F.col("v")
    got = [
        tuple(r)
        for r in df.select(display.short_delta(c), display.delta_text(c), display.delta_sign(c)).collect()
    ]
    for value, (short, full, sign) in zip(values, got):
        if value is None:
            assert (short, full, sign) == ("—", "—", "")
        elif value == "oops":
            assert (short, full, sign) == ("oops", "oops", "text")
        else:
            v = float(value)
            assert short == (str(int(v)) if v == int(v) else f"{v:.1f}")
            assert full == f"{v:.4f}"
            assert sign == ("negative" if v < 0 else "positive" if v > 0 else "zero")


def test_classes_and_dashes(spark):
    df = spark.createDataFrame([("In Production",), ("done",), ("Hot",), ("",), (None,), ("0",)], "v string")
    c = F.col("v")
    got = df.select(
        display.status_class(c), display.priority_class(c), display.dash_if_empty(c), display.dash_if_empty(c, True)
    ).collect()
    assert [tuple(r) for r in got] == [
        ("in-production", "x", "In Production", "In Production"),
        ("x", "x", "done", "done"),
        ("x", "hot", "Hot", "Hot"),
        ("x", "x", "—", "—"),
        ("x", "x", "—", "—"),
        ("x", "x", "0", "—"),
    ]
