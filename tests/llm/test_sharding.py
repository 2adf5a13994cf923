"""Stratified interleaving against plain sorting, and files of shards."""

import glob
import hashlib
import math
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from loomset.llm import queries, sharding

SCHEMA = "doc_id long, text string, source string, lang string, Slot string, size string"


def _brute(rows, shards=8, seed="shard"):
    keyed = []
    for doc_id, text, source in rows:
        data = (text or "").encode()
        crc, size = zlib.crc32(data), len(data) + 1
        keyed.append(("-" if source is None else "=" + source, hashlib.md5(f"{seed}:{'none' if doc_id is None else doc_id}:{crc}:{size}".encode()).hexdigest(), (doc_id is not None, doc_id or 0), crc, size))
    of, seen, order = Counter(k[0] for k in keyed), Counter(), []
    for k in sorted(keyed, key=lambda k: (k[0].encode(), *k[1:])):
        seen[k[0]] += 1
        order.append(((seen[k[0]] - 0.5) / of[k[0]], k[0].encode(), *k[1:]))
    n, out = len(keyed), []
    for p, (_, _, _, doc, crc, size) in enumerate(sorted(order)):
        s = p * shards // n
        out.append((doc[1] if doc[0] else None, size, crc, s, p - -(-s * n // shards)))
    return Counter(out)


def _rows(n):
    return [(None if i % 17 == 0 else i, None if i % 11 == 0 else f"text {i % 40} " + "é" * (i % 7), None if i % 13 == 0 else "hot" if i % 3 else f"s{i % 5}", "en", "x", "y") for i in range(n)] + [(5, "text 5", "hot", "en", "x", "y")] * 9


@pytest.mark.parametrize("n,rows_each", [(0, 1_000_000), (1, 1_000_000), (300, 1_000_000), (900, 3)])
def test_equals_plain_sorting(spark, monkeypatch, n, rows_each):
    monkeypatch.setattr(sharding, "ROWS", rows_each)
    rows = _rows(n) if n != 1 else [(3, None, None, None, None, None)]
    rows = rows if n else []
    df = spark.createDataFrame(rows, SCHEMA)
    for shards in (8, 3):
        got = Counter(tuple(r) for r in sharding.place(df.repartition(5), shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect())
        assert got == _brute([r[:3] for r in rows], shards)


def test_shards_have_the_mixture(spark):
    df = spark.createDataFrame(_rows(2000), SCHEMA)
    placed = sharding.place(df).collect()
    each = Counter(r["shard"] for r in placed)
    assert max(each.values()) - min(each.values()) <= 1
    of, held = Counter(r["stratum"] for r in placed), Counter((r["stratum"], r["shard"]) for r in placed)
    assert all(abs(held[s, k] - n / 8) < 2 for s, n in of.items() for k in range(8))
    # and so has a stretch inside a shard
    part = Counter(r["stratum"] for r in placed if r["shard"] == 2 and 50 <= r["slot"] < 150)
    assert all(abs(part[s] - 100 * n / len(placed)) < 2 for s, n in of.items())


def test_files_of_shards(spark, tmp_path):
    rows = _rows(500) + [(7000, "x" * 300_000, "hot", "de", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    sharding.write(df, str(tmp_path / "out"), shards=4)
    got = []
    for s in range(4):
        files = [pq.ParquetFile(f).read().to_pylist() for f in sorted(glob.glob(f"{tmp_path}/out/shard={s}/*.parquet"))]
        one = [r for f in files for r in f]
        assert [r["slot"] for r in one] == list(range(len(one))) and abs(len(one) - len(rows) / 4) < 1
        got += [(r["doc_id"], r["text"], r["source"], r["lang"], r["size"]) for r in one]
    assert Counter(got) == Counter((r[0], r[1], r[2], r[3], r[5]) for r in rows)
    want = Counter(tuple(r) for r in sharding.place(df, 4).select("doc_id", "text_crc32", "shard", "slot").collect())
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert want == Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in back)


def test_ranges_follow_the_rows():
    """16 ** digits ranges of a source keep to ROWS rows each."""
    for most in (1, 10**6, 10**9, 10**13):
        digits = max(2, math.ceil(math.log(max(1, most / sharding.ROWS), 16)))
        assert most / 16**digits <= sharding.ROWS


def test_registered_query_equals_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    want = duckdb.sql(f"WITH documents AS (SELECT * FROM '{data}/documents.parquet') SELECT * FROM ({queries.ORACLES['op12_sharding']})")
    columns = want.columns
    assert {tuple(r) for r in queries.QUERIES["op12_sharding"](spark, data).select(*columns).collect()} == set(want.fetchall())
