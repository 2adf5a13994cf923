"""The whole query against plain loops, the block-max index against all cosines, and held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from loomset.llm import toxicity


def _unit_entries(rng, n, terms, share):
    row, term = np.nonzero(rng.random((n, terms)) < share)
    return row, term, toxicity.unit(row, rng.integers(1, 4, len(row)).astype(float), n)


def test_nearest_are_exact_with_ties():
    rng = np.random.default_rng(5)
    for n, terms, k in ((700, 60, 15), (700, 3000, 15), (40, 20, 15), (3, 5, 15), (0, 4, 3)):
        row, term, weight = _unit_entries(rng, n, terms, 0.05)
        index = toxicity.Index(np.sort(rng.choice(10**6, n, False)), rng.integers(0, 2, n), row, term, weight, terms)
        dense = np.zeros((n, terms))
        dense[row, term] = weight
        row, term, weight = _unit_entries(rng, 50, terms, 0.1)
        q = np.zeros((50, terms))
        q[row, term] = weight
        cosine, place, scored = index.nearest(row, term, weight, 50, k)
        for i in range(50):
            every = np.round(dense @ q[i], 12)
            want = sorted((-c, j) for j, c in enumerate(every) if c > 1e-12)[:k]
            assert [j for _, j in want] == index.given[place[i][place[i] >= 0]].tolist()
            assert np.allclose([-c for c, _ in want], cosine[i][: len(want)], atol=2e-12)


def test_blocks_out_of_reach_are_skipped():
    """Examples of 40 topics: a text's own topic fills its neighbours, so most blocks are never scored."""
    rng = np.random.default_rng(6)
    n, topics = 4000, 40
    topic = np.arange(n) % topics
    row = np.repeat(np.arange(n), 9)
    term = np.where(np.arange(9 * n) % 9 == 8, 0, 1 + topic[row] * 50 + rng.integers(0, 50, 9 * n))
    row, term = np.array(sorted(set(zip(row.tolist(), term.tolist(), strict=True)))).T
    weight = toxicity.unit(row, np.where(term == 0, 0.2, 2.0), n)
    index = toxicity.Index(np.arange(n), topic % 2, row, term, weight, 1 + topics * 50)
    some = row < 200
    _, _, scored = index.nearest(row[some], term[some], weight[some], 200, 15)
    assert scored < 200 * index.n_blocks / 2


def _plain(docs, labels, k=15):
    """score, predicted and evidence of every row by dictionaries."""

    def vector(text):
        return Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")))

    known = {}
    for i, v in labels:
        if i is not None and v is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[i] = max(known.get(i, 0), v)
    examples = [(i, known[i], vector(t)) for i, t in docs if i in known]
    df = Counter(w for _, t in docs for w in vector(t))
    idf = {w: 1 + math.log((1 + len(docs)) / (1 + n)) for w, n in df.items()}
    n1 = sum(y for _, y, _ in examples)
    n0 = len(examples) - n1
    ones, others = Counter(), Counter()
    for _, y, v in examples:
        (ones if y else others).update(set(v))

    def unit(v, drop=None):
        w = {}
        for t, n in v.items():
            if t in ones or t in others:
                a, c = ones[t] - (drop == 1), others[t] - (drop == 0)
                w[t] = (1 + math.log(n)) * idf[t] * math.log2(2 + a / max(1, c) * n0 / n1)
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    vectors = [unit(v) for _, _, v in examples]
    share = sum(known.values()) / len(known)
    weigh = ((1 - share) / (n0 / len(examples)), share / (n1 / len(examples)))

    def near(q, skip=None):
        found = [(sum(x * e.get(t, 0) for t, x in q.items()), j) for j, e in enumerate(vectors) if j != skip]
        return sorted([f for f in found if f[0] > 1e-12], reverse=True)[:k]

    def vote(found):
        w = [(weigh[examples[j][1]] / (1.05 - c), examples[j][1]) for c, j in found]
        return sum(a * y for a, y in w) / sum(a for a, _ in w) if w else None

    votes = [vote(near(unit(v, y), j)) for j, (_, y, v) in enumerate(examples)]
    pools = []
    for x, y in sorted((x, y) for x, (_, y, _) in zip(votes, examples, strict=True) if x is not None):
        pools.append([x * weigh[y], y * weigh[y], weigh[y]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    lone = [(weigh[y] * y, weigh[y]) for x, (_, y, _) in zip(votes, examples, strict=True) if x is None]
    prior = sum(a for a, _ in lone) / sum(b for _, b in lone) if lone else share
    out = {}
    for i, t in docs:
        found = near(unit(vector(t)))
        v = vote(found)
        p = prior if v is None else float(np.interp(v, [a / c for a, _, c in pools], [b / c for _, b, c in pools]))
        out[i] = (p, int(round(p, 6) >= 0.3), [examples[j][0] for _, j in found])
    return out


def test_whole_query_equals_plain_loops(spark, tmp_path):
    rng = np.random.default_rng(8)
    syllables = ["ka", "to", "ri", "mu", "sel", "Ö", "né", "9"]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(400)]
    docs, labels = [], []
    for i in range(420):
        bad = rng.random() < 0.25
        text = list(rng.choice(vocabulary, rng.integers(5, 90))) + (list(rng.choice(["Vile", "scum", "rot"], 2)) if bad else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text) + f", u{i}"))
        labels.append((i, int(bad)))
    docs += [(1000, ""), (1001, None), (1002, "?! ..."), (1003, "VILE"), (1004, "never seen")]
    labels += [(None, 1), (3, None), (2000, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()}
    want = _plain(docs, labels)
    assert len(got) == len(docs) == len(want)
    for i, (p, predicted, evidence) in want.items():
        assert abs(got[i]["score"] - p) < 2e-6 and got[i]["predicted"] == predicted, i
        assert list(got[i]["evidence"]) == evidence, i
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i]["evidence"] for i in range(420)) and not got[1002]["evidence"]


def test_examples_stay_within_their_bytes(spark):
    rows = [(i, f"good day w{i} " * 200 + "vile scum " * (i % 2)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, most_bytes=200_000)
    assert 20 < len(model.index.ids) < 140
    assert {r["predicted"] == r["doc_id"] % 2 for r in toxicity.classify(docs, model, ["doc_id"]).collect()} == {True}


def test_toxic_words_are_found_and_edge_cases_defined(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = int(rng.random() < 0.3)
        text = list(rng.choice(plain, 30)) + (["idiot", "moron"] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, bad))
    rows += [(1000, ""), (1001, None), (1002, "unknown letters only"), (None, "idiot moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, model, ["doc_id"]).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert got[None]["predicted"] == 1 and len(got[None]["evidence"]) == toxicity.K
    assert {got[i]["predicted"] for i in (1000, 1001, 1002)} == {0}
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.classify(docs, none, ["doc_id"]).collect()} == {0.0}


def test_ids_of_any_whole_number_type(spark):
    """The model and the scores are the same for int and long ids."""
    words = ["good", "fine", "day", "rotten", "vile", "scum"]
    rows = [(i, " ".join([words[i % 3], words[(i // 3) % 3], *(words[3:] if i % 4 == 0 else [])])) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id int, toxic int")
    scores = []
    for kind in ("int", "long"):
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        got = toxicity.classify(docs, toxicity.learn(docs, labels), ["doc_id"])
        assert got.schema["doc_id"].dataType.simpleString() == {"int": "int", "long": "bigint"}[kind]
        scores.append(sorted((r["doc_id"], r["score"]) for r in got.collect()))
    assert scores[0] == scores[1] and len(scores[0]) == 80 and max(s for _, s in scores[0]) > 0.5
