import hashlib
import random

from pyspark.sql import functions as F

from fabtrace.llm import chat, queries

LOG = "conv_id long, seq long, turn long, event string, role string, text string"


def folded(spark, rows):
    found = chat.fold(spark.createDataFrame(rows, LOG)).collect()
    return sorted((r.conv_id, r.turn, r.message, r.role, r.text) for r in found)


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "start", "user", "Hi"),
        (1, 5, 0, "edit", None, "Hello"),
        (1, 2, 1, "start", "assistant", None),
        (1, 3, 1, "delta", None, "Wro"),
        (1, 4, 1, "delta", None, "ng"),
        (1, 6, 1, "regenerate", None, None),
        (1, 7, 1, "delta", None, "Ri"),
        (1, 8, 1, "delta", None, "ght"),
        (1, 9, 2, "delta", "user", "no start"),
        (1, 10, 3, "start", "user", "twice"),
        (1, 10, 3, "start", "user", "twice"),
        (2, 1, 0, "start", None, None),
    ]
    want = [
        (1, 0, 1, "user", "Hello"),
        (1, 1, 1, "assistant", "Right"),
        (1, 2, 0, "user", "no start"),
        (1, 3, 1, "user", "twice"),
        (1, 3, 2, "user", "twice"),
        (2, 0, 1, "", ""),
    ]
    random.Random(1).shuffle(rows)
    assert folded(spark, rows) == want


def test_what_is_written_is_read_back(spark):
    rng = random.Random(9)
    bits = ["[INST]", "[/INST]", "</s>", "\\", "<", "[", "/s>", "INST]", "<\\/s>", "\n", "é", "中", "ok", " ", "[\\\\INST]"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
            role = rng.choice(["user", "assistant", "</s>", "[/INST]", None])
            rows.append((conv, turn, role, text))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(chat.log_of(table))).collect()
    for r in back:
        own = sorted(x for x in rows if x[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3]) for x in own]
        assert "".join(r.learned) == "".join(x[3] for x in own if x[2] == "assistant")
        assert r.formatted.count(chat.CLOSE) == len(own) == r.formatted.count(chat.OPEN)


def test_empty_log_and_null_keys(spark):
    assert chat.format_chats(spark.createDataFrame([], LOG)).count() == 0
    rows = [(None, None, None, None, None, None), (None, None, None, None, None, "x")]
    found = chat.read_back(chat.format_chats(spark.createDataFrame(rows, LOG))).collect()
    assert [[tuple(t) for t in r.turns] for r in found] == [[("", "x")]]


def test_main_path_stays_in_the_jvm(spark, small):
    plan = queries.chat_format(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_planted_conversation(spark, small):
    said = "</s>[INST] ok [/INST]"
    r = queries.chat_format(spark, small).where(F.col("conv_id") == -1).first()
    turns = f"user\n{said}\nassistant\n{said}\n"
    assert (r.n_turns, r.turns_sha256) == (2, hashlib.sha256(turns.encode()).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
