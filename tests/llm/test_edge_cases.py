"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator, and the registered queries on a whole table."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomset.llm import decontaminate, lang_id, line_dedup, mix_sources, near_dedup, quality, queries, toxicity
from loomset.llm.common import discard, passing, settle, shared_dir

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}" for i in range(120_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score string, TAKEN string, spans string, `kept` string"
ROWS = [
    (1, "plain words of a text", "en", "a", 21), (1, "plain words of a text", "en", "a", 21), (1, "another text under the same id", "en", None, 30), (None, "no id here at all", None, "b", 17),
    (None, "no id here either, but longer", "en", "b", 29), (None, None, None, None, None), (4, "", "de", "a", 0), (5, None, "de", "a", None), (6, LONG, "en", "a", len(LONG)), (7, "12 ... !!", None, "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "k") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None), (1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")


def _runs(docs, labels):
    bench = docs.sparkSession.createDataFrame([("i", "plain words"), (None, "another text"), ("n", None)], "item_id string, text string")
    return {
        "language": lang_id.identify(docs, lang_id.learn(docs)),
        "toxicity": toxicity.classify(docs, toxicity.learn(docs, labels), docs.columns),
        "quality": quality.classify(docs, quality.learn(docs, labels), docs.columns),
        "mix": mix_sources.mix(docs),
        "benchmark": decontaminate.find(docs, bench),
        "lines": line_dedup.dedup_lines(docs, passages=True),
        "near": near_dedup.near_duplicates(docs),
    }


@pytest.mark.parametrize("name", ["language", "toxicity", "quality", "mix", "benchmark", "lines", "near"])
def test_every_row_has_a_result(docs, labels, name):
    got = _runs(docs, labels)[name].collect()
    assert len(got) == len(ROWS)
    rank = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in got), key=rank) == sorted((r[0] for r in ROWS), key=rank)


@pytest.mark.parametrize("name", ["language", "toxicity", "quality", "mix", "benchmark", "lines", "near"])
def test_empty_tables(docs, labels, name):
    assert _runs(docs.limit(0), labels.limit(0))[name].count() == 0


@pytest.mark.parametrize("name", ["language", "toxicity", "quality"])
def test_repeated_rows_and_ids_score_alike(docs, labels, name):
    """A score follows from the text, wherever it stands and whatever its id."""
    moved = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)) + 1000).union(docs)
    model = {"language": lambda: lang_id.learn(docs), "toxicity": lambda: toxicity.learn(docs, labels), "quality": lambda: quality.learn(docs, labels)}[name]()
    run = {"language": lang_id.identify, "toxicity": toxicity.classify, "quality": quality.classify}[name]
    scores = {}
    for r in run(moved, model, ["doc_id", "text", "n_chars"]).collect():
        scores.setdefault((r["text"], r["n_chars"]), set()).add(r["score"])
    assert all(len(x) == 1 for x in scores.values())


def test_mix_of_null_and_repeated_ids_is_the_same_again(docs):
    many = docs.union(docs.filter("doc_id IS NULL")).union(docs.filter("doc_id = 1"))
    seen = []
    for n, digits in ((1, 1), (5, 2), (3, 4)):
        got = mix_sources.materialise(mix_sources.mix(many.repartition(n), digits=digits)).select("doc_id", F.sha2("text", 256).alias("t"), "taken", "epoch").collect()
        seen.append(sorted(map(repr, got)))
    assert seen[0] == seen[1] == seen[2]


def test_key_ranges_follow_the_rows(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"))
    want = sorted(map(repr, mix_sources.mix(rows).collect()))
    monkeypatch.setattr(mix_sources, "ROWS", 5)
    assert sorted(map(repr, mix_sources.mix(rows, digits=1).collect())) == want


def test_running_sums_over_many_ranges(spark):
    rng = np.random.default_rng(8)
    v = [int(x) for x in rng.integers(0, 50, 300)]
    rows = spark.createDataFrame([(int(i), v[i]) for i in rng.permutation(300)], "k long, v long")
    got = {r["k"]: r["s"] for r in mix_sources.running(rows, ["k"], s=F.col("v")).collect()}
    assert got == dict(enumerate(np.cumsum(v).tolist()))


def test_registered_language_of_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "lang").filter("lang IS NOT NULL")
    rows = lang_id.op2_lang_id(spark, data).filter("held_out AND lang_pred <> 'und'").join(truth, F.col("doc_id") == F.col("id")).collect()
    assert len(rows) > 50 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("name,column,least", [("op3_toxicity", "toxic", 0.75), ("op8_quality", "quality", 0.95)])
def test_registered_scores_rank_held_out_rows(spark, name, column, least):
    """The area under the curve, which the share of either label doesn't raise."""
    data = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{data}/labels.parquet").select(F.col("doc_id").alias("id"), F.col(column).alias("truth")).filter("truth IS NOT NULL")
    rows = queries.QUERIES[name](spark, data).filter("held_out").join(truth, F.col("doc_id") == F.col("id")).collect()
    ones, others = [r["score"] for r in rows if r["truth"]], [r["score"] for r in rows if not r["truth"]]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in others])
    assert min(len(ones), len(others)) > 5 and area > least and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", ["op2_lang_id", "op3_toxicity", "op6_line_dedup", "op8_quality", "op10_near_dedup"])
def test_registered_query_returns_every_document(spark, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()) == ids


def _tables(spark):
    place = f"{shared_dir(spark).removeprefix('file://')}/loomset"
    return {f"{d}/{x}" for d, names, _ in os.walk(place) for x in names}


def test_tables_made_on_the_way_are_deleted(spark, docs):
    spark.range(1).write.mode("ignore").parquet(f"{shared_dir(spark)}/loomset/other")
    before = _tables(spark)
    found = near_dedup.near_duplicates(docs)
    assert len(_tables(spark) - before) == 1 and found.count() == len(ROWS)
    discard(found)
    assert _tables(spark) == before
    with passing(spark):
        with passing(spark):
            inner = settle(spark.range(3), "inner", keep=True)
        assert inner.count() == 3
    assert _tables(spark) == before
    rows = corpus_pipeline.run(spark, DATA)
    left = sorted(os.path.basename(x).split("-")[0] + "-" + os.path.basename(x).split("-")[1] for x in _tables(spark) - before if "stage-" in x)
    assert left == ["stage-decontaminated"] and rows.count() > 0
