"""Edit-aware token counts against encoding the whole text again."""

import base64

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomset.llm import token_counts as tc

RANKS = open(tc.RANKS, "rb").read()
ENCODE = tc.encoding(RANKS).encode_ordinary
TEXT = st.text(alphabet="ab c'sd.,1 \n\t é世", max_size=60)


@given(TEXT, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 20), TEXT), max_size=4))
@settings(max_examples=400, deadline=None)
def test_every_edit_equals_encoding_anew(text, edits):
    size, tc.leaves.__defaults__ = tc.leaves.__defaults__, (5,)
    try:
        tree = tc.Tree(text, ENCODE)
        assert tree.total == len(ENCODE(text))
        for start, deleted, inserted in edits:
            start = min(start, len(text))
            text = text[:start] + inserted + text[start + deleted :]
            tree.edit(start, deleted, inserted)
            assert tree.text == text
            assert tree.total == len(ENCODE(text))
    finally:
        tc.leaves.__defaults__ = size


def test_long_text_encodes_little():
    text = " ".join(f"word{i}" for i in range(20000))
    tree = tc.Tree(text, ENCODE)
    before = tree.encoded
    tree.edit(70000, 4, "other")
    assert tree.encoded - before <= 3
    assert tree.total == len(ENCODE(tree.text))


def test_table_with_nulls_and_columns(spark):
    rows = [(1, "some text here", [(0, 4, "Other")], "x"), (2, None, [(3, 1, "new")], "y"), (3, "", None, None), (None, "<|endoftext|>", [], "z"), (1, "some text here", [(0, 4, "Other")], "x")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {tc.EDIT}, n_leaves_note string")
    got = tc.count_edited(df).collect()
    assert len(got) == 5
    for r in got:
        assert r["n_tokens_after"] == len(ENCODE(r["edited"])) and r["n_tokens"] == len(ENCODE(r["text"] or ""))
    assert {r["edited"] for r in got} == {"Other text here", "new", "", "<|endoftext|>"}
    assert tc.count_edited(spark.createDataFrame([], df.schema)).count() == 0


def test_trees_are_kept_between_runs(spark, tmp_path):
    texts = [" ".join(f"word{i}" for i in range(4000)), "short", "", None, "x" * 5000, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Tree", F.lit("the caller's"))
    tc.kept_trees(docs).write.parquet(str(tmp_path / "trees"))
    kept = spark.read.parquet(str(tmp_path / "trees"))
    edits = F.expr(f"cast(array(named_struct('start', 10, 'deleted', 3, 'inserted', 'new')) as {tc.EDIT})")
    tc.count_edited(kept.withColumn("edits", edits), tree="tree").write.parquet(str(tmp_path / "second"))
    second = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "second")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert second[i]["edited"] == t[:10] + "new" + t[13:] and second[i]["n_tokens"] == len(ENCODE(t))
        assert second[i]["n_tokens_after"] == len(ENCODE(second[i]["edited"]))
    assert second[0]["n_leaves"] > 60 and second[0]["n_encoded"] <= 2
    # the trees after the edits serve the next run; those of other texts are made anew
    after = spark.read.parquet(str(tmp_path / "second")).select("doc_id", F.col("edited").alias("text"), F.col("edited_tree").alias("tree"))
    none = F.expr(f"cast(null as {tc.EDIT})")
    third = {r["doc_id"]: r for r in tc.count_edited(after.withColumn("edits", none), tree="tree").collect()}
    assert all(r["n_encoded"] == 0 and r["n_tokens"] == second[i]["n_tokens_after"] for i, r in third.items())
    stale = tc.count_edited(after.withColumn("text", F.concat(F.lit("z"), "text")).withColumn("edits", none), tree="tree").collect()
    assert all(r["n_tokens"] == len(ENCODE(r["edited"])) for r in stale if r["edited"]) and any(r["n_encoded"] > 60 for r in stale)


def test_query_against_whole_encodings(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = tc.op9_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and all(r["n_tokens"] == len(ENCODE(texts[r["doc_id"]])) for r in got)
    assert sum(r["n_encoded"] for r in got) < sum(r["n_leaves"] for r in got)
