"""Every registered query outside the text-corpus subpackage against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomset import catalogue

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(_plain, r))) for r in df.select(*columns).collect())
    if name in catalogue.ORACLES:
        rel = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})")
        assert got == sorted(repr(tuple(map(_plain, r))) for r in rel.fetchall())
    else:
        assert got


def test_rotation_covers_all_vectors(spark, duck):
    got = {r["vec_id"] for r in catalogue.QUERIES["hadamard_rotate"](spark, DATA).select("vec_id").distinct().collect()}
    assert len(got) > 100 and got == {r[0] for r in duck.sql("SELECT vec_id FROM embeddings").fetchall()}
