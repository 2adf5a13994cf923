"""Chat formatting: exact round trips, the machine, and the query against its SQL."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomset.llm import chat_format as cf

PIECES = st.lists(st.sampled_from(["### ", "User: ", "</turn>", "\n", "\\", "#", "<", "/turn>", "a", "é", "@", ":", "##", "### Assistant: "]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a:b\n", "User", None]) | PIECES, PIECES | st.none()), min_size=1, max_size=6))
@settings(max_examples=25, deadline=None)
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = cf.format_conversations(df).withColumn("back", cf.read_turns(F.col("formatted"))).first()
    assert [(x["role"], x["text"]) for x in got["back"]] == [(r or "", t or "") for r, t in turns]
    learned = "".join(s["text"] for s in got["segments"] if s["loss"])
    assert learned.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == "".join(t or "" for r, t in turns if r == "assistant")


def test_machine(spark):
    cases = {"ua": (True, None), "sua": (True, None), "suaua": (True, None), "u": (False, 1), "au": (False, 0), "uua": (False, 1), "us": (False, 1), "s": (False, 1), "uaua": (True, None)}
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(c, i, names[x], "t") for c in cases for i, x in enumerate(c)]
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in cf.format_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert got == cases


def test_ties_nulls_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(None, None, None, None, "x"), (1, 1, "user", "b", "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "x")]
    got = {r["conv_id"]: r for r in cf.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[None]["n_turns"] == 1 and got[1]["formatted"].count("a</turn>") == 2 and got[1]["formatted"].index("a</turn>") < got[1]["formatted"].index("b</turn>")
    assert cf.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_long_texts(spark):
    text = "### x </turn> \\" * 100_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    back = cf.format_conversations(df).select(cf.read_turns(F.col("formatted")).alias("b")).first()["b"]
    assert [hashlib.md5(x["text"].encode()).hexdigest() for x in back] == [hashlib.md5(text.encode()).hexdigest()] * 2
