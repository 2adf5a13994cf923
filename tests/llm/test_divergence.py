"""The audit against plain loops over whole numbers, and the tournament."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from loomset.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, TERM string, v string, cell binary"


def _brute(rows, top=200, least_docs=3):
    unit, groups, docs = 10**9, defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for (lang, source), count in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def p(c, kept=kept):
            return lambda t: 1 + unit * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))

        peers = [s for lang_, s in groups if lang_ == lang and s != source]
        of_lang = sum((c for (lang_, _), c in groups.items() if lang_ == lang), Counter())
        mine = {t: p(count)(t) for t in kept}
        whole = {t: p(of_lang)(t) for t in kept}
        pairs = []
        for s in peers:
            other = {t: p(groups[lang, s])(t) for t in kept}
            pairs.append((sum((mine[t] - other[t]) ** 2 // other[t] for t in kept), s))
        terms = [((mine[t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def _rows(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "BETA", "gämma", "日本", "d", "épsilon", "zeta's", "x1y", "ÉTA", "éta", "rare", "same", "like"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot", "hot", "a", "b", "c", "dé", "e", None])
        rows.append((" ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 15))), rng.choice(["en", "fr", None]), source))
    return rows + [(None, "en", "textless"), ("123 !!", "en", "wordless"), ("only once here", "xx", "a"), ("", "xx", "b"), ("all alone alone", "one", "a")] + [("the same the same", "cp", s) for s in ("a", "b", "b", "c")]


def _df(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y", None) for i, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("team,cell,top", [(8, 500_000, 200), (2, 40, 3), (1, 10, 1)])
def test_equals_plain_loops(spark, team, cell, top):
    rows = _rows(team, 150)
    assert _got(divergence.audit(_df(spark, rows), top=top, team=team, cell=cell)) == _brute(rows, top)


def test_tiny_tables(spark):
    for rows in ([], [(None, None, None)], [("a a a", "l", "s"), ("a", "l", "s"), ("a b", "l", "t")], [("a" * 100_000 + " b", "l", "s")] * 3 + [("b", "l", "t")]):
        assert _got(divergence.audit(_df(spark, rows))) == _brute(rows)


@pytest.mark.parametrize("teams", [2, 4, 6, 8, 14])
def test_all_teams_meet_once(teams):
    met = [tuple(sorted(x)) for r in range(teams - 1) for x in divergence.circle(teams, r)]
    assert sorted(met) == sorted(combinations(range(teams), 2))
    assert all(len({t for x in divergence.circle(teams, r) for t in x}) == teams for r in range(teams - 1))


def test_quotients_are_exact():
    rng = random.Random(1)
    b = [rng.randrange(1, 1 << rng.randrange(1, 53)) for _ in range(2000)]
    a = [rng.randrange(0, x + 1) for x in b]
    got = divergence._quotient(np.array(a, np.int64), np.array(b, np.int64))
    assert got.tolist() == [10**9 * x // y for x, y in zip(a, b, strict=True)]


def test_hosts_stay_where_they_are(spark, monkeypatch):
    """In a round only visitors are shuffled: the hosts' side of the join reads its buckets."""
    plans, settle = [], divergence.settle

    def seen(df, name):
        if name == "round":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, name)

    monkeypatch.setattr(divergence, "settle", seen)
    divergence.audit(_df(spark, _rows(3, 80)), team=2).collect()
    assert len(plans) >= 3 and all("Bucketed: true" in p and p.count("Exchange") == 1 for p in plans), plans[0]


def test_registered_query_equals_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    want = duckdb.sql(f"WITH documents AS (SELECT * FROM '{data}/documents.parquet') SELECT * FROM ({queries.ORACLES['op11_source_divergence']})")
    columns = want.columns
    assert sorted(tuple(r) for r in queries.QUERIES["op11_source_divergence"](spark, data).select(*columns).collect()) == sorted(want.fetchall())
