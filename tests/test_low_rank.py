"""Low-rank factors of matrices whose rows are dealt over tasks."""

import numpy as np
import pytest

from loomset.operators import lowrank, tensors


def _rows(spark, matrices):
    return spark.createDataFrame([(m, i, r.astype("f4").tolist()) for m, d in matrices.items() for i, r in enumerate(d)], "module string, row long, delta array<float>").repartition(5)


def _product(rows, name, rank, alpha):
    made = {}
    for r in rows.collect():
        made.setdefault(r["key"], []).append((r["row"], r["values"]))
    up, down = (np.array([x for _, x in sorted(made[f"{name}.lora_{s}.weight"])]) for s in ("up", "down"))
    assert made[f"{name}.alpha"] == [(None, [alpha])]
    return up @ down * (alpha / rank)


@pytest.mark.parametrize("slot_bytes", [1, 64 << 20])
def test_basis_and_adapter_of_known_matrices(spark, slot_bytes):
    rng = np.random.default_rng(11)
    u, v = (np.linalg.qr(rng.standard_normal((n, 4)))[0] for n in (90, 33))
    known = {"m": (u * np.array([4.0, 2.0, 1.0, 0.5])) @ v.T, "zero": np.zeros((6, 10)), "flat": rng.standard_normal((3, 20)), "tall": rng.standard_normal((700, 2))}
    basis, rows = lowrank.adapter(_rows(spark, known), rank=4, alpha=8.0, block=16, slot_bytes=slot_bytes)
    got = {r["module"]: r for r in basis.collect()}
    assert np.allclose(got["m"]["sigma"], [4, 2, 1, 0.5], atol=1e-5) and abs(got["m"]["energy"] - 1) < 1e-6
    assert got["flat"]["rank"] == 3 and got["tall"]["rank"] == 2 and abs(got["flat"]["energy"] - 1) < 1e-9
    assert got["zero"]["energy"] == 1.0 and np.allclose(got["zero"]["sigma"], 0)
    for name, d in known.items():
        assert np.abs(_product(rows, name, got[name]["rank"], 8.0) - d).max() < 1e-4


def test_surplus_rank_is_zeroed(spark):
    """Directions beyond the delta's own rank are zeros, not noise."""
    rng = np.random.default_rng(5)
    d = np.outer(rng.standard_normal(60), rng.standard_normal(40)) + np.outer(rng.standard_normal(60), rng.standard_normal(40))
    basis, rows = lowrank.adapter(_rows(spark, {"m": d}), rank=12, block=8, slot_bytes=1)
    r = basis.first()
    b = np.array(r["basis"]).reshape(40, 12)
    assert np.allclose(r["sigma"][:2], np.linalg.svd(d.astype("f4"), compute_uv=False)[:2], rtol=1e-6) and np.abs(r["sigma"][2:]).max() < 1e-4
    assert np.allclose(b.T[:2] @ b[:, :2], np.eye(2), atol=1e-9) and abs(r["energy"] - 1) < 1e-9
    assert np.abs(_product(rows, "m", 12, 12.0) - d).max() < 1e-4


def test_orthonormal_zeroes_dependent_columns():
    y = np.array([[1.0, 2.0, 0.0, 1e-9], [0.0, 0.0, 3.0, 1.0], [1.0, 2.0, 0.0, 0.0]])
    q = lowrank.orthonormal(y)
    kept = q[:, [0, 2]]
    assert np.allclose(kept.T @ kept, np.eye(2)) and np.allclose(q[:, 1], 0)
    assert np.allclose(lowrank.orthonormal(np.zeros((4, 2))), 0)


def test_energy_below_full_rank(spark):
    d = np.random.default_rng(3).standard_normal((200, 24)) * np.linspace(3, 0.1, 24)
    s = np.linalg.svd(d.astype("f4"), compute_uv=False)
    r = lowrank.low_rank_basis(_rows(spark, {"m": d}), rank=8, block=32).first()
    assert abs(r["energy"] - (s[:8] ** 2).sum() / (s**2).sum()) < 1e-3
    assert lowrank.low_rank_basis(_rows(spark, {"m": d}).limit(0)).count() == 0


def test_small_singular_values_keep_their_digits(spark):
    """The tree of QRs doesn't square the condition: a value of 1e-4 of the largest is still right, where its square would pass for noise."""
    rng = np.random.default_rng(8)
    u, v = (np.linalg.qr(rng.standard_normal((n, 3)))[0] for n in (80, 20))
    s = np.array([1.0, 1e-2, 1e-4])
    d = ((u * s) @ v.T).astype("f4")
    got = lowrank.low_rank_basis(_rows(spark, {"m": d}), rank=3, block=16, slot_bytes=1).first()["sigma"]
    assert np.allclose(got, np.linalg.svd(d.astype("f8"), compute_uv=False)[:3], rtol=1e-6)


def test_pairs_of_headers_are_sorted_in_parts_that_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(tensors, "ROWS", 100)
    side = spark.range(950).selectExpr("concat('net.w', id, '.weight') AS key", "'F16' AS dtype", "array(id, 2L) AS shape")
    pairs = tensors.lora_pairs(side, side)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 950 and plan.count(", 10), REPARTITION_BY_NUM") == 2 and "Broadcast" not in plan
