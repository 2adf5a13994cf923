"""Near duplicates: alignment, sketches and whole results against brute force; and the pipeline's stages."""

import os
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomset.llm import near_dedup as nd
from loomset.llm import queries
from loomset.llm.components import components


WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_equal_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(800):
        a, b = (rng.integers(0, 5, int(rng.integers(0, 25))).astype(np.uint64) for _ in range(2))
        if rng.random() < 0.6:
            b = np.array([x for x in a if rng.random() > 0.1] + list(b[:3]), np.uint64)
        most = int(rng.integers(0, 14))
        assert nd.edits(a, b, most) == min(_distance(a.tolist(), b.tolist()), most + 1)


def test_sketch_equals_brute_force():
    rng = np.random.default_rng(2)
    value, first = rng.integers(0, 30, 60).astype(np.uint64), np.array([0, 40, 40, 43, 60])
    kmers, got = nd.labelled(value, first), nd.sketch(value, first, 6, 4)
    assert not got[1].any()
    for r in (0, 2, 3):
        own = kmers[first[r] : first[r + 1]].tolist()
        assert len(set(own)) == len(own)
        for j in range(6):
            odd = int(nd.mix(np.array([j], np.uint64), 100)[0]) | 1
            picked = sorted(sorted(range(len(own)), key=lambda i: (own[i] * odd % 2**64 >> 32, i))[:4])
            digest = np.full(1, j + 1, np.uint64)
            for x in [own[p] for p in picked] + [0] * (4 - len(picked)):
                digest = nd.mix(digest * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x), 33)
            assert digest.view(np.int64)[0] == got[r, j]


def test_parities_bound_edits():
    rng = np.random.default_rng(8)
    rows = []
    for n in (1, 30, 200, 700, 2500):
        a = rng.integers(0, n, n).astype(np.uint64)
        for share in (0.0, 0.05, 0.2, 0.6):
            b = np.array([x if rng.random() > share else rng.integers(0, 2 * n) for x in a if rng.random() > share / 3], np.uint64)
            rows += [a, b]
    flat, first = nd.mix(np.concatenate(rows), 1), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    parity, begin = nd.parities(nd.labelled(flat, first), first)
    narrow = nd.narrowed(parity, begin)
    bits = lambda x: sum(int(v).bit_count() for v in x.view(np.uint64))
    for i in range(0, len(rows), 2):
        most = max(len(rows[i]), len(rows[i + 1]))
        d = nd.edits(rows[i], rows[i + 1], most)
        x, y = (parity[begin[i + k] : begin[i + k + 1]] for k in (0, 1))
        few = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, few), 0) for z in (x, y))
        gap = abs(len(rows[i]) - len(rows[i + 1]))
        assert bits(narrow[i] ^ narrow[i + 1]) <= bits(x ^ y) <= 2 * d - gap


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (20, 20), (5, 30), (30, 31), (31, 32), (32, 33), (33, 4)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 5: 4, 30: 4, 31: 4, 32: 4, 33: 4, 4: 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _corpus(rng):
    word = lambda: "".join(chr(97 + int(d)) for d in str(rng.integers(100, 3000)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(60, 160)))]
        texts.append(base)
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, len(base) // 40)))):
                copy[int(rng.integers(len(copy)))] = word()
            texts.append(copy)
    passage = [word() for _ in range(30)]
    texts += [[word() for _ in range(60)] + passage + [word() for _ in range(60)] for _ in range(10)]
    return [" ".join(t) for t in texts]


def test_whole_result_equals_brute_force(spark):
    texts = _corpus(np.random.default_rng(3))
    rows = list(enumerate(texts)) + [(500, texts[0].upper()), (501, ""), (502, None), (503, "..."), (504, "two words"), (505, "Two, words!"), (None, texts[1])]
    got = {r["doc_id"]: r for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    words = {i: t.lower().replace(",", "").replace("!", "").replace(".", "").split() for i, t in rows if t and i is not None}
    label = {i: i for i in words}
    near = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 1 - _distance(a, b) / max(len(a), len(b)) >= 0.8
    pairs = [(i, j) for i in words for j in words if i < j and words[i] and words[j] and near(words[i], words[j])]
    for _ in range(len(words)):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert len(pairs) > 10
    assert {i: got[i]["class_id"] for i in words} == label
    assert got[501]["class_id"] == 501 and got[502]["class_id"] == 502 and got[505]["class_id"] == 504
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rare_grams_of_similar_texts_meet(spark):
    texts = _corpus(np.random.default_rng(5)) + ["one", "two words", "", "a a a a a b", "a a a a b"]
    rows = spark.createDataFrame([(i, t, len(t.split())) for i, t in enumerate(texts)], "cls long, text string, n_words long").repartition(3)
    own = {}
    for r in nd.rare_grams(rows, 0.8).collect():
        assert len(r["gram"]) <= nd.GRAMS and r["q"] <= r["most_q"]
        for g, low, high in zip(r["gram"], r["low"], r["high"]):
            own.setdefault((r["cls"], r["q"]), {})[g] = (low, high)
    most = {}
    for c, q in own:
        most[c] = max(q, most.get(c, 0))
    split, met = [t.split() for t in texts], 0
    for i, a in enumerate(split):
        for j, b in enumerate(split[:i]):
            if a and b and 1 - _distance(a, b) / max(len(a), len(b)) >= 0.8:
                q, reach = min(most[i], most[j]), int(0.2 * max(len(a), len(b)) + 1e-9)
                x, y = own[i, q], own[j, q]
                assert any(x[g][0] - reach <= y[g][1] and y[g][0] - reach <= x[g][1] for g in x.keys() & y.keys())
                met += 1
    assert met > 10


def test_grams_are_counted_and_those_of_one_text_left_out(spark):
    texts = ["only this text says so", "common start of a text here", "common start of a text there", "z " * 700, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cls long, text string").repartition(3)
    slots = 1 << 20
    want = np.zeros((2, slots), int)
    for t in texts:
        h = nd.words(*nd.utf8(nd.pa.array([t])))[2]
        for q in (1, 2):
            np.add.at(want[q - 1], (nd._grams(h, np.array([0, len(h)]), q)[0] & np.uint64(slots - 1)).astype(int), 1)
    assert (nd.gram_counts(rows, slots) == np.minimum(want, 255)).all() and want.max() == 700
    assert {r["cls"] for r in nd.rare_grams(rows, 0.8, slots=slots).collect()} - {3} == {1, 2}


def test_few_texts_of_a_bucket_need_no_grams(spark, monkeypatch):
    rng, seen, real = np.random.default_rng(31), [], nd._by_grams
    monkeypatch.setattr(nd, "_by_grams", lambda open_, *a: seen.append(open_.count()) or real(open_, *a))
    word = lambda: f"w{rng.integers(10**6)}"
    rows, want = [], {}
    for k in range(8):  # texts with a passage in common, and of each twin the edits are outside
        passage = [word() for _ in range(50)]
        texts = [[word() for _ in range(50)] + passage for _ in range(4)]
        texts.append([word() if i in range(0, 36, 2) else x for i, x in enumerate(texts[2])])
        rows += [(10 * k + i, " ".join(t)) for i, t in enumerate(texts)]
        want |= {10 * k + i: 10 * k + (2 if i == 4 else i) for i in range(5)}
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and seen == [0]


def test_a_common_passage_makes_no_pairs_but_loses_none(spark):
    rng = np.random.default_rng(21)
    word = lambda: f"w{rng.integers(10**6)}"
    passage = [word() for _ in range(50)]
    texts = [[word() for _ in range(50)] + passage for _ in range(60)]
    twin = list(texts[7])
    for i in range(0, 38, 2):  # all edits fall outside the passage
        twin[i] = word()
    texts.append(twin)
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(rows).collect()}
    assert got == {i: 7 if i == 60 else i for i in range(61)}


def test_rows_are_told_by_id_and_words(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    long = " ".join(f"x{i % 977}" for i in range(30000))
    rows = [(1, a, 0), (2, b, 1), (2, a, 2), (2, a.upper(), 3), (None, b, 4), (None, b, 5), (5, b + " more", 6), (None, "lone text", 7), (None, "lone text", 8), (6, "", 9), (6, "", 10), (None, None, 11), (7, long, 12), (8, long + " y", 13), (7, long, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("d1", F.lit("kept")).withColumn("maybe", F.lit(1)).repartition(3)
    out = nd.one_of_each(docs)
    got = out.collect()
    assert out.columns == docs.columns and all(r["d1"] == "kept" for r in got)
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in got) == sorted([(1, a[:9]), (2, b[:9]), (0, "lone text"), (6, ""), (6, ""), (0, ""), (7, long[:9])])
    marks = {(r["doc_id"], r["d1"]): (r["class_id"], r["kept"]) for r in nd.near_duplicates(docs.drop("d1", "maybe", "row")).collect() if r["n_words"] == 40}
    assert sorted((str(k[0]), v) for k, v in marks.items()) == [("1", (1, True)), ("2", (1, False)), ("2", (2, True)), ("None", (2, False))]


def test_chains_join_through_members_that_no_hub_links(spark):
    rng = np.random.default_rng(9)
    base, texts = [f"b{i}" for i in range(200)], []
    for step in range(7):  # each differs from the one before by 20 words, so the ends are unlike
        texts.append(" ".join(base))
        for i in rng.choice(200, 20, False):
            base[i] = f"n{step}x{i}"
    got = {r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m=60, l=2).collect()}
    assert got == {0}


def test_scattered_edits_are_found_down_to_the_threshold(spark):
    rng, rows, want = np.random.default_rng(12), [], {0.8: [], 0.85: [], 0.9: []}
    for least, pairs in want.items():
        for _ in range(100):
            a = [f"u{x}" for x in rng.integers(0, 10**9, int(rng.integers(60, 300)))]
            b = list(a)
            for i in rng.choice(len(a), int((1 - least) * len(a) + 1e-9), False):
                b[i] = f"v{rng.integers(10**9)}"
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = {least: sum(got[a] == got[b] for a, b in pairs) for least, pairs in want.items()}
    assert found[0.8] >= 97 and found[0.85] >= 99 and found[0.9] == 100, found
    assert all(got[a] in (a, a - 1) for a in got)


def test_pipeline_stages(spark, tmp_path):
    texts = _corpus(np.random.default_rng(4))
    passage = " ".join(f"bad{chr(97 + i % 10)}{chr(97 + i // 10)}" for i in range(60))
    item = " ".join(f"cab{chr(97 + i % 10)}{chr(97 + i // 10)}" for i in range(14))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(900 + i, f"own words number {i} here\n{passage}", "en", "s0", None) for i in range(3)] + [(950, f"before it {item} after it", "en", "s1", 5), (960, "123 456", None, None, 7), (970, None, "en", "s0", None), (980, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "Margin", "lang_pred", "spans", "items", "n_removed", "gone", "text_hash", "row", "size", "target", "_gone", "label", "hash"):
        docs = docs.withColumn(c, F.lit("kept"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, []
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path)).cache()
        if name != "mixed":
            assert at.columns == columns and at.filter("score <> 'kept' OR spans <> 'kept' OR n_removed <> 'kept' OR gone <> 'kept' OR row <> 'kept'").count() == 0
        ids.append({r["doc_id"] for r in at.select("doc_id").collect()})
        if name == "lines":
            cut = {r["doc_id"]: r["text"] for r in at.filter("doc_id between 900 and 902").collect()}
            assert passage in cut[900] and passage not in cut[901] and passage not in cut[902]
    assert {960, 970, 980}.isdisjoint(ids[0]) and {950, 0, 900} <= ids[0]
    assert len(ids[2]) < len(ids[1]) and 0 in ids[2]
    assert 950 in ids[2] and 950 not in ids[3] and ids[2] - ids[3] == {950}
    assert set(columns) <= set(at.columns) and at.filter("taken < 1").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_language_stage_rejects_letters_of_no_language(spark):
    rng = np.random.default_rng(13)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter("doc_id >= 0")
    scripts = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", *("".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x4E00, 0x4F00), (0x3B1, 0x3C9)))]
    junk = [" ".join("".join(rng.choice(list(s), int(rng.integers(2, 9)))) for _ in range(n)) for s in scripts for n in (60, 200) for _ in range(15)]
    clean = [r["text"].split() for r in docs.filter("lang IS NOT NULL AND length(text) > 400").orderBy("doc_id").limit(60).collect()]
    short = [" ".join(w[:4]) for w in clean]
    more = [(-1 - i, x, None) for i, x in enumerate(junk)] + [(-1000 - i, x, None) for i, x in enumerate(short)]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string")), "").collect()}
    assert not kept & {-1 - i for i in range(len(junk))}
    assert len(kept & {-1000 - i for i in range(len(short))}) == len(short)
    assert docs.filter("length(text) > 400 AND lang IS NOT NULL").select("doc_id").distinct().count() == len({i for i in kept if i >= 0} & {r["doc_id"] for r in docs.filter("length(text) > 400 AND lang IS NOT NULL").collect()})


def test_query_covers_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.QUERIES["op10_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == docs.count() and {r["class_id"] for r in got} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    # every exact copy of words shares its class
    own = {}
    text = {r["doc_id"]: " ".join(WORD.findall((r["text"] or "").lower())) for r in docs.collect()}
    for r in got:
        if text[r["doc_id"]]:
            assert own.setdefault(text[r["doc_id"]], r["class_id"]) == r["class_id"]


def test_a_crowd_around_the_threshold_makes_no_row_for_each_pair(spark, monkeypatch):
    rng, counts, real = np.random.default_rng(41), {}, nd.settle
    word, frame = lambda: f"w{rng.integers(60)}", ["over", "again"] * 60
    texts = [[word() for _ in range(int(rng.integers(38, 52)))] + frame for _ in range(240)]
    texts += [[word() if rng.random() < 0.4 else x for x in t[:40]] + t[40:] for t in texts[:20]]

    def settle(df, name, **keep):
        out = real(df, name, **keep)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(nd, "settle", settle)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = [r["class_id"] for r in nd.near_duplicates(docs).orderBy("doc_id").collect()]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    rows = [np.array([number[w] for w in t], np.uint64) for t in texts]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    near = nd.similar([rows[i] for i, _ in pairs], [rows[j] for _, j in pairs], nd.THRESHOLD)
    label = list(range(len(rows)))
    for (i, j), _ in filter(lambda x: x[1], zip(pairs, near, strict=True)):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == label and 20 < len(set(label)) < 250
    assert counts["met"] < 20 * len(texts), counts  # 32,167 where each text met each label at a gram


def test_components_by_rounds_equal_those_of_one_task(spark, monkeypatch):
    from loomset.llm import components as step

    links = spark.createDataFrame([(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (20, 20), (5, 30), (30, 31), (31, 4)], "a long, b long")
    whole = {r["node"]: r["label"] for r in components(links).collect()}
    for few in (0, 2):  # never one task; and one after rounds
        monkeypatch.setattr(step, "FEW_LINKS", few)
        assert {r["node"]: r["label"] for r in components(links).collect()} == whole
    assert whole == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 5: 4, 30: 4, 31: 4, 4: 4}


def test_sketches_go_once_buckets_are_known_and_texts_are_shuffled_once(spark, monkeypatch):
    rng, real, places, seen = np.random.default_rng(43), nd.settle, {}, {}

    def settle(df, name, **keep):
        if name == "texts":
            seen["exchanges"] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        if name == "pairs" and "left" not in seen:
            seen["left"] = [n for n in ("sketches", "classes") if os.path.exists(places[n])]
        out = real(df, name, **keep)
        places.setdefault(name, os.path.dirname(out.inputFiles()[0].removeprefix("file://")) if out.inputFiles() else "")
        return out

    monkeypatch.setattr(nd, "settle", settle)
    texts = [[f"w{x}" for x in rng.integers(500, size=60)] for _ in range(40)]
    texts += [[*t[:30], "other", *t[31:]] for t in texts[:10]] + texts[:5]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [r["class_id"] for r in nd.near_duplicates(docs).orderBy("doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [*range(40), *range(10), *range(5)]
    assert seen == {"exchanges": 2, "left": []}  # both sides of the join; before, the groups shuffled texts again


def test_common_grams_keep_their_order_beyond_a_byte():
    n = np.array([0, 1, 2, 100, 127, 128, 200, 255, 300, 1000, 60_000, 1_000_000])
    steps = nd._stepped(n)
    assert (np.diff(steps) >= 0).all() and steps.max() <= nd.MANY and (steps[:5] == n[:5]).all() and len(set(steps[-5:])) == 5


def test_texts_of_a_crowd_travel_only_if_their_parities_allow_a_similar_one(spark, monkeypatch):
    rng, real = np.random.default_rng(47), nd.settle
    word, passage = lambda: f"w{rng.integers(60)}", [f"p{i}" for i in range(50)]
    texts = [[word() for _ in range(50)] + passage for _ in range(160)]
    texts += [[word() if rng.random() < 0.3 else x for x in t[:50]] + passage for t in texts[:16]]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    rows = [np.array([number[w] for w in t], np.uint64) for t in texts]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    label = list(range(len(rows)))
    for (i, j), _ in filter(lambda x: x[1], zip(pairs, nd.similar([rows[i] for i, _ in pairs], [rows[j] for _, j in pairs], nd.THRESHOLD), strict=True)):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(nd, "CROWD", 2)
    for signs, block in ((nd.__dict__.get("SIGNS"), nd.BLOCK), (2, 2)):  # a crowd in one block, and in many
        counts = []

        def settle(df, name, counts=counts, **keep):
            out = real(df, name, **keep)
            if name == "crowds":
                counts.append(out.count())
            return out

        monkeypatch.setattr(nd, "settle", settle)
        monkeypatch.setattr(nd, "SIGNS", signs, raising=False)
        monkeypatch.setattr(nd, "BLOCK", block)
        assert [r["class_id"] for r in nd.near_duplicates(docs).orderBy("doc_id").collect()] == label and 160 <= len(set(label)) < 170
        # those that meet by parities, and then by words; before, all went with their words
        assert counts[0] > 2000 and counts[-1] < 0.25 * counts[0], counts


def test_folded_parities_bound_edits_and_earlier_grams_are_told(spark):
    rng, rows = np.random.default_rng(48), []
    for n in (5, 100, 300, 3000):
        a = rng.integers(0, n, n).astype(np.uint64)
        rows += [a, np.array([x if rng.random() > 0.1 else rng.integers(2 * n) for x in a], np.uint64)]
    flat, first = nd.mix(np.concatenate(rows), 1), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    parity, begin = nd.parities(nd.labelled(flat, first), first)
    whole = [parity[x:y].tolist() for x, y in zip(begin, begin[1:])]
    got = [r["f"] for r in spark.createDataFrame(list(enumerate(whole)), "i long, p array<long>").select("i", nd._folded(F.col("p")).alias("f")).orderBy("i").collect()]
    for few, own in zip(got, whole, strict=True):
        assert len(few) == max(8, len(own) // nd.FOLD) and few == np.bitwise_xor.reduce(np.array(own).reshape(-1, len(few)), 0).tolist()
    mine = [rng.choice(300, int(rng.integers(0, 40)), False).tolist() for _ in range(60)]
    bits = nd._earlier(nd.pa.array(mine, nd.pa.list_(nd.pa.int64())))
    assert all((bits[i] & bits[j]).any() == bool(set(mine[i]) & set(mine[j])) for i in range(60) for j in range(i))
