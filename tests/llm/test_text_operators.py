"""Mixing, decontamination, exact deduplication, language and quality: brute force, SQL, and defined edge cases."""

import math
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomset.llm import decontaminate, exact_dedup, lang_id, mix_sources, quality, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


# --- mixing ---


def _targets(sizes: dict) -> dict:
    """Deals again and again, as the rule is told."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        unit = left / max(1, sum(weight[s] for s in free))
        above = [s for s in free if unit * weight[s] > 2 * sizes[s]]
        if not above:
            return out | {s: unit * weight[s] for s in free}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mix_meets_budgets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["b", "a", "d", "c", None][int(rng.integers(5))] if i % 3 else "hot", " ".join("w" * int(rng.integers(1, 4)) for _ in range(int(rng.integers(0, 40))))) for i in range(900)] + [(5000, "empty", ""), (5001, "empty", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_sources.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = _targets(dict(sizes))
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mix_sources.mix(docs.repartition(7), digits=1).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    copies = mix_sources.materialise(mix_sources.mix(docs)).select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in copies} == {k: v for k, v in again.items() if v}
    assert mix_sources.mix(spark.createDataFrame([], docs.schema)).count() == 0


# --- decontamination ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _fold(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _hits(text, items, window=10):
    w, hit, found = _fold(text), set(), set()
    for name, item in items:
        p = _fold(item)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if p else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 60])
def test_search_equals_brute_force(spark, pattern_bytes):
    rng = np.random.default_rng(4)
    vocabulary = ["A", "b", "é", "cc", "1", "Zz"]
    phrase = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(str(i), phrase(int(rng.integers(0, 16)))) for i in range(12)] + [("x", "... "), ("3", phrase(12)), ("y", "lone-Word")]
    texts = [phrase(int(rng.integers(0, 60))) for _ in range(40)] + [f"zz {items[3][1]}, {items[5][1]}!" for _ in range(3)] + ["", None, "Lone word", " ".join(["a"] * 3000) + " " + items[2][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, ("z", None)], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(docs, bench, pattern_bytes=pattern_bytes).collect()}
    for i, t in enumerate(texts):
        n, hit, found = _hits(t, items)
        r = got[i]
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) == (n, hit, found), i
    assert decontaminate.find(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontaminate.find(docs.limit(0), bench).count() == 0


# --- exact copies ---


def test_dedup_tells_colliding_digests_apart(spark, tmp_path):
    rows = [(5, "a  b"), (3, "a\nb"), (9, "c"), (1, None), (2, ""), (7, "d"), (None, "c"), (4, "a b "), (3, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d.parquet"))
    path = str(tmp_path / "d.parquet")
    docs = spark.read.parquet(path)
    want = sorted([(5, 3, 3), (3, 3, 3), (3, 3, 3), (9, 9, 2), (0, 9, 2), (1, 1, 2), (2, 1, 2), (7, 7, 1), (4, 4, 1)])
    for digest in (exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 0), lambda t: F.length(t).cast("string")):
        got = exact_dedup.dedup(docs, exact_dedup.file_stream(spark, path, "doc_id long, text string", files=1), digest).collect()
        assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in got) == want
        assert sum(r["kept"] for r in got) == 6


# --- language and quality ---


def test_languages(spark):
    def text(rng, letters, n):
        return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))

    rng = np.random.default_rng(6)
    kinds = {"aa": "abcde", "bb": "bcdxé", "cc": "жзийк", "dd": "𐐀𐐁𐐂"}
    rows = [(i, text(rng, kinds[k], int(rng.integers(3, 30))), k) for i in range(80) for k in kinds]
    docs = spark.createDataFrame(rows + [(1, "abc", None), (2, None, "aa"), (3, "12 ...", "bb")], "doc_id long, text string, lang string")
    prototypes = lang_id.learn(docs.repartition(5))
    assert all(np.array_equal(v, lang_id.learn(docs.repartition(2))[k]) for k, v in prototypes.items())
    probe = [(i, text(rng, kinds[k], 8), k) for i in range(25) for k in kinds] + [(900, "", "und"), (901, None, "und"), (902, "123 !!", "und")]
    got = lang_id.identify(spark.createDataFrame(probe, "doc_id long, text string, want string"), prototypes).collect()
    assert sum(r["lang_pred"] == r["want"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] >= 900)
    assert {r["lang_pred"] for r in lang_id.identify(docs, {}).collect()} == {"und"}
    # scores equal those of vectors bundled trigram by trigram
    w, x = "abé", np.zeros(lang_id.DIMS)
    s = [0, *map(lang_id._symbol, w), 0]
    base = lang_id.letters(np.array(s)).astype(float)
    for i in range(3):
        x += np.roll(base[i], 2) * np.roll(base[i + 1], 1) * base[i + 2]
    one = lang_id.identify(spark.createDataFrame([(1, "Abé")], "doc_id long, text string"), prototypes).first()
    assert abs(one["score"] - max(0, max(x @ p / np.linalg.norm(x) for p in prototypes.values()))) < 1e-5


def test_factorisation_machine(spark):
    rng = np.random.default_rng(7)
    v, w = rng.normal(size=(quality.SIZE, quality.RANK)).astype("f4"), rng.normal(size=quality.SIZE).astype("f4")
    index, value, first = rng.choice(quality.SIZE, 12, False), rng.normal(size=12).astype("f4"), np.array([0, 5, 12])
    got = quality.score((0.5, w, v), index, value, first)
    for r in range(2):
        x = range(first[r], first[r + 1])
        pairs = sum(float(v[index[i]] @ v[index[j]]) * value[i] * value[j] for i in x for j in x if i < j)
        assert abs(got[r] - (0.5 + sum(w[index[i]] * value[i] for i in x) + pairs)) < 1e-3
    good = [(i, " ".join(rng.choice(["the", "of", "word", "and"], 20)) + ".", 100, 1) for i in range(150)]
    bad = [(200 + i, " ".join(rng.choice(["the$$$", "of###", "AND!!"], 20)), None, 0) for i in range(150)]
    docs = spark.createDataFrame(good + bad + [(999, None, None, 0), (998, "", 0, 0)], "doc_id long, text string, n_chars long, quality int")
    model = quality.learn(docs.drop("quality"), docs.select("doc_id", "quality"))
    got = {r["doc_id"]: r for r in quality.classify(docs.drop("quality"), model, ["doc_id"]).collect()}
    assert all(got[r[0]]["predicted"] == r[3] for r in good + bad) and all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 302
    none = quality.learn(docs.drop("quality"), docs.select("doc_id", "quality").limit(0))
    assert {r["score"] for r in quality.classify(docs.drop("quality"), none, ["doc_id"]).collect()} == {0.5}


def test_every_quality_score_is_the_pairwise_sum_of_its_row(spark):
    """The whole result: each row's features taken alone, and all pairs of them summed in a loop."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) < 3000").select("doc_id", "text", "n_chars").union(spark.createDataFrame([(-1, None, None), (-2, "", 5)], "doc_id long, text string, n_chars long"))
    bias, w, v = model = quality.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = docs.collect()
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, model, ["doc_id"]).collect()}
    assert len(got) == len(rows) > 50
    for r in rows:
        text = (r["text"] or "").encode()
        one = pa.RecordBatch.from_arrays([pa.array([r["n_chars"]], pa.int64())], names=["n_chars"])
        index, value, _ = quality.features(one, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        vx = v[index].astype(float) * value[:, None]
        total = float(bias) + float(w[index].astype(float) @ value) + sum(float((vx[i] * vx[i + 1 :]).sum()) for i in range(len(index)))
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-total))) < 1e-4


def test_every_language_is_that_of_plain_loops(spark):
    """The whole query: learning rows bundled and documents compared a trigram at a time."""
    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect() if len(r["text"] or "") < 3000]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in rows] + [(-1, None, "en"), (-2, "...", None), (-3, "Ünïcode 𐐀𐐁", None)]
    known, vector = {}, {}

    def bundle(text):
        out, n = np.zeros(lang_id.DIMS), 0
        s = [0, *map(lang_id._symbol, text or ""), 0]
        for gram in zip(s, s[1:], s[2:]):
            if gram[1]:
                if gram not in vector:
                    a, b, c = lang_id.letters(np.array(gram)).astype(float)
                    vector[gram] = np.roll(a, 2) * np.roll(b, 1) * c
                out, n = out + vector[gram], n + 1
        return out, n

    bundled = {i: bundle(text) for i, text, _ in rows}
    learned = {i for i, text, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2 and text is not None and lang is not None}
    for i, _, lang in rows:
        if i in learned:
            x, n = bundled[i]
            known[lang] = known.get(lang, 0) + max(1, lang_id.TEXT_WEIGHT // max(1, n)) * x
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    prototypes = lang_id.learn(docs.filter(docs.doc_id.isin(sorted(learned))))
    assert sorted(prototypes) == sorted(known)
    got = {r["doc_id"]: r for r in lang_id.identify(docs.drop("lang"), prototypes).collect()}
    assert len(got) == len(rows) > 50
    for i, (x, n) in bundled.items():
        scores = sorted(((float(x @ p / np.linalg.norm(x) / np.linalg.norm(p)), k) for k, p in known.items()), key=lambda s: (-s[0], s[1])) if n else [(0.0, "und")]
        assert abs(got[i]["score"] - max(0.0, scores[0][0])) < 1e-4
        assert got[i]["lang_pred"] == scores[0][1] or scores[0][0] - scores[1][0] < 1e-5
