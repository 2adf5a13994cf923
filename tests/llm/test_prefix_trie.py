"""The trie of prefixes against one built by plain loops."""

import hashlib
import random
import zlib

import pytest

from loomset.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _ordered(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by.setdefault(c, []).append(((turn is not None, turn or 0), role, d, text))
    return {c: [(x[1], x[3]) for x in sorted(t)] for c, t in by.items()}


def _rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def _brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        childless = [q for q in under if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in under), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _got(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _random(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 200), n):
        if rows and rng.random() < 0.25:  # a copy, whole or cut, of another conversation
            other = rng.choice(rows)[0]
            own = [r for r in rows if r[0] == other]
            rows += [(c, *r[1:]) for r in own[: rng.randint(1, len(own))]]
        else:
            rows += [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bé", None, "a longer text", "日本"])) for t in range(rng.randint(1, 12))]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_loops(spark, seed):
    rows = _random(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    convs = _ordered(rows)
    assert _got(prefix_trie.trie(df)) == _brute(convs)
    assert _got(prefix_trie.build(prefix_trie.rebuilt(prefix_trie.sequences(df)))) == _brute(_rebuilt(convs))


def test_edge_cases(spark):
    """Null ids belong nowhere; copies of a very long conversation leave the levels at once; turnless conversations end at the root."""
    long = [(t, "user" if t % 2 else "assistant", f"text {t} " + "x" * 50) for t in range(60)]
    rows = [(c, *x) for c in (8, 3, 21) for x in long] + [(None, 0, "user", "lost"), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (5, 0, None, None)] + [(c, 0, "user", "x" * 20_000) for c in (90, 91)]
    df = spark.createDataFrame([(*r, "more") for r in rows], SCHEMA + ", DEPTH string")
    convs = _ordered(rows)
    assert _got(prefix_trie.trie(df)) == _brute(convs)
    want = _rebuilt(convs)
    assert any(not t for t in want.values())
    assert _got(prefix_trie.build(prefix_trie.rebuilt(prefix_trie.sequences(df)))) == _brute(want)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "a")], [(4, None, None, None)], [(7, 0, "u", "a"), (9, 0, "u", "a")]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(prefix_trie.trie(df)) == _brute(_ordered(rows))
    assert _got(prefix_trie.build(prefix_trie.rebuilt(prefix_trie.sequences(df)))) == _brute(_rebuilt(_ordered(rows)))


def test_hash_of_ids_over_batches(spark):
    """One node's ids in many batches have the digest of their whole list."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, 0, "user", "same") for c in range(100)] + [(1000 + c, 0, "user", f"t{c % 3}") for c in range(50)]
        assert _got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == _brute(_ordered(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_registered_query_equals_sql(spark):
    import duckdb

    from loomset.llm import queries

    data = "/root/testdata/sf0.001"
    want = duckdb.sql(f"WITH conversations AS (SELECT * FROM '{data}/conversations.parquet') SELECT * FROM ({queries.ORACLES['op13_prefix_trie']})")
    columns = want.columns
    assert {tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, data).select(*columns).collect()} == set(want.fetchall())
