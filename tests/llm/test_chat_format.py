import hashlib

from pyspark.sql import functions as F

from heronflow.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def digest(spark, rows):
    out = chat.format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    back = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: r for r in back.collect()}


def test_round_trip_of_hard_texts(spark):
    hard = ["", None, "</s>[INST] ok [/INST]", "a\\", "\\\\</s>", "<\\s>", "<sep>", "[", "<", "😀<s>é\n", "<s", "/INST]", "\\"]
    rows = [(1, k, ("user", "assistant", "assistant", "[/INST] x", None)[k % 5], t) for k, t in enumerate(hard * 12)]
    got = digest(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert got.loss == "".join(t or "" for _, _, r, t in rows if r == "assistant")


def test_merging_across_parts_and_ties(spark):
    rows = [(2, k // 2, "assistant", f"t{k:03}") for k in range(300)] + [(None, None, "user", "x"), (None, None, "user", "x")]
    got = digest(spark, rows)
    assert got[2].formatted.count("<s>") == 1 and [t.text for t in got[2].turns] == [f"t{k:03}" for k in range(300)]
    assert len(got[None].turns) == 2 and got[None].loss == ""
    assert hashlib.sha256(got[2].loss.encode()).hexdigest() == hashlib.sha256("".join(f"t{k:03}" for k in range(300)).encode()).hexdigest()


def test_empty(spark):
    assert digest(spark, []) == {}


def test_very_long_texts_and_conversations(spark):
    long = "é</s>\\ " * 150_000
    rows = [(1, k, ("user", "assistant")[k % 2], long) for k in range(3)] + [(2, k, ("user", "assistant")[k % 2], f"{k} <s>") for k in range(3000)]
    got = digest(spark, rows)
    assert [t.text == long for t in got[1].turns] == [True] * 3 and got[1].loss == long
    assert [t.text for t in got[2].turns] == [f"{k} <s>" for k in range(3000)]
