import hashlib
import random

from pyspark.sql import functions as F

from evenkeel.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
BITS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE ", "[ROLE 61] ", "\\", "[\\INST]", "<\\\\s>"]
BITS += ["<", "[", "a", " ", "\n", "é", "]", "/", "s>", "INST]"]


def _conversations(n, seed=3):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 5)):
            role = r.choice(["user", "assistant", "system", "tool", "", "</s>", None])
            text = r.choice([None, ""] + ["".join(r.choices(BITS, k=r.randint(0, 9)))] * 8)
            rows.append((conv, turn, role, text, "clash"))
    return rows


def test_round_trip_of_control_strings(spark):
    rows = _conversations(300)
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.formatted(df).select(
        "conv_id", "formatted", "layout", "escapes", chat.parsed(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("layout")).alias("loss"),
    ).collect()
    assert len(out) == 300
    for got in out:
        own = [(role or "", text or "") for conv, _, role, text, _ in rows if conv == got["conv_id"]]
        assert [(t["role"], t["text"]) for t in got["turns"]] == own
        assert got["loss"] == "".join(t for role, t in own if role == "assistant")
        # spans of the loss mask point at the formatted text, and no control string stands bare inside a body
        for (role, text), at in zip(own, got["layout"], strict=True):
            block = got["formatted"][at["start"] : at["start"] + at["length"]]
            assert block.startswith("<s>") and block.endswith("</s>") and "</s>" not in block[:-4]
            span = got["formatted"][at["loss_start"] : at["loss_start"] + at["loss_length"]]
            assert (span != "") == (role == "assistant" and text != "")


def test_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi \\ there", ""), (1, 1, "assistant", "[x] <b>", "")], SCHEMA)
    row = chat.formatted(df).first()
    assert row["formatted"] == "<s>[INST] hi \\ there [/INST]</s><s>[x] <b></s>"
    assert not row["escapes"]


def test_digest_edges(spark):
    rows = [(None, None, None, None, ""), (5, 0, "user", "a", ""), (5, 0, "user", "a", ""), (5, 0, "user", None, "")]
    got = {r["conv_id"]: r for r in chat.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None]["n_turns"] == 1 and got[5]["n_turns"] == 3
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\na\nuser\na\n").hexdigest()
    assert got[5]["loss_chars"] == 0 and got[5]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    long = spark.createDataFrame([(1, i, "assistant", "word </s> " * 200, "") for i in range(400)], SCHEMA)
    assert chat.digest(long).first()["loss_chars"] == 400 * 2000
    assert chat.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "")], SCHEMA)
    plan = chat.digest(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan
