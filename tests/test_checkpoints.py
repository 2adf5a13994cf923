"""Checkpoint files: ranges of chosen tensors, parallel writes that fail and are tried again, merges, adapters and quantised files."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import checkpoints, tensors
from loomset.sources import safetensors, tensorfile

SCHEMA = "key string, dtype string, shape array<bigint>, ord bigint, values array<float>"


def _file(spark, path, held, extra=None):
    """held: key -> (dtype, array); integers are written as they are."""
    rows, raw = [], []
    for i, (k, (dtype, x)) in enumerate(held.items()):
        data = safetensors.encode(np.asarray(x, "f4").ravel(), dtype) if dtype in ("F32", "F16", "BF16") else np.asarray(x).tobytes()
        rows.append((k, dtype, list(np.shape(x)), i, data))
    safetensors.write(spark.createDataFrame(rows, "key string, dtype string, shape array<bigint>, ord bigint, data binary").repartition(3), str(path), extra)
    return str(path), raw


def _back(spark, path):
    """key -> (dtype, shape, bytes), ranges put together."""
    out = {}
    for r in safetensors.read(spark, str(path), chunk_bytes=64).orderBy("ord", "row").collect():
        out[r["key"]] = (r["dtype"], list(r["shape"]), out.get(r["key"], (0, 0, b""))[2] + bytes(r["data"]))
    return out


def _weights(seed, n=3, dtype="F32"):
    rng = np.random.default_rng(seed)
    return {f"blocks.{i}.attn.weight": (dtype, rng.standard_normal((40, 64)) * 0.1) for i in range(n)}


def test_filters_reach_the_header(spark, tmp_path):
    path, _ = _file(spark, tmp_path / "a", {"net.b": ("F32", np.arange(800).reshape(100, 8)), "net.a": ("F16", [1, 2, 3]), "s": ("F32", 7.0), "e": ("F32", np.zeros((0, 4))), "i": ("I64", np.array([5], "<i8"))})
    got = safetensors.read(spark, path, F.col("key").startswith("net.") & (F.col("dtype") == "F32") & (F.size("shape") == 2), chunk_bytes=1000)
    rows = got.collect()
    assert [(r["row"], r["rows"], len(r["data"])) for r in rows] == [(0, 31, 992), (31, 31, 992), (62, 31, 992), (93, 7, 224)]
    assert np.array_equal(np.frombuffer(b"".join(bytes(r["data"]) for r in rows), "<f4"), np.arange(800, dtype="f4"))
    assert {r["key"] for r in safetensors.read(spark, path, ~F.col("key").isin("s", "i")).collect()} == {"net.a", "net.b", "e"}
    assert {r["key"] for r in safetensors.read(spark, path, F.length("key") == 1).collect()} == {"s", "e", "i"}
    # filters of one frame don't mix
    whole = safetensors.read(spark, path)
    assert [r["key"] for r in whole.filter("key = 's'").select("key").unionByName(whole.filter("key = 'i'").select("key")).collect()] == ["s", "i"] and whole.count() == 5


def test_only_wanted_bytes_are_read(spark, tmp_path):
    """The bytes of all ranges of the chosen tensors, counted; and a task reads its ranges alone."""
    path, _ = _file(spark, tmp_path / "a", {f"t{i}": ("F32", np.full((50, 10), i)) for i in range(20)})
    reader = tensorfile.TensorReader({"path": path, "tensors": "[7]", "chunkbytes": "500", "partitionbytes": "1000"})
    parts = reader.partitions()
    assert sum(c[7] - c[6] for p in parts for c in p.chunks) == 2000 and max(sum(c[7] - c[6] for c in p.chunks) for p in parts) <= 1000
    with open(path, "r+b") as f:  # the bytes of all later tensors are cut off: what is read doesn't need them
        f.truncate(max(c[7] for p in parts for c in p.chunks))
    data = b"".join(x.column("data")[0].as_py() for p in parts for x in reader.read(p))
    assert np.array_equal(np.frombuffer(data, "<f4"), np.full(500, 7, "f4"))


def test_writes_that_do_not_fit_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "x")
    plan = [("a", "F32", [4]), ("b", "U8", [3])]
    rows = lambda *r: spark.createDataFrame(list(r), "key string, at long, data binary")
    (tmp_path / "x").write_bytes(b"old")
    for bad in ([("a", 0, b"x" * 16)], [("a", 0, b"x" * 16), ("b", 0, b"abc"), ("b", 1, b"b")], [("a", 0, b"x" * 16), ("b", 0, b"abcd")], [("a", 0, b"x" * 16), ("c", 0, b"abc")], [("a", -1, b"x" * 16), ("b", 0, b"abc")], [("a", 4, b"x" * 12), ("b", 0, b"abc")]):
        with pytest.raises(Exception, match="planned|tile|missing"):
            tensorfile.write(rows(*bad), path, plan)
        assert os.listdir(tmp_path) == ["x"] and (tmp_path / "x").read_bytes() == b"old"
    tensorfile.write(rows(("b", 1, b"bc"), ("a", 8, b"y" * 8), ("a", 0, b"x" * 8), ("b", 0, b"a")).repartition(3), path, plan)
    assert {k: x[2] for k, x in _back(spark, path).items()} == {"a": b"x" * 8 + b"y" * 8, "b": b"abc"} and os.listdir(tmp_path) == ["x"]
    tensorfile.write(rows().limit(0), path, [("e", "F32", [0])])
    assert _back(spark, path) == {"e": ("F32", [0], b"")}


KILLED = """
import os, sys
import pyarrow as pa
from pyspark.sql import SparkSession
sys.path.insert(0, {root!r})
from loomset.sources import tensorfile
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def run(batches):
    for b in batches:
        for k in b.column("id").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(["t"]), pa.array([k * 4]), pa.array([bytes([k] * 4)])], ["key", "at", "data"])
            if k == 37 and not os.path.exists({mark!r}):
                open({mark!r}, "w").close()
                os._exit(1)  # the worker dies in the middle of a task
tensorfile.write(spark.range(64, numPartitions=4).mapInArrow(run, "key string, at long, data binary"), {path!r}, [("t", "U8", [256])])
"""


def test_a_killed_task_runs_again(spark, tmp_path):
    root, mark, path = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), str(tmp_path / "mark"), str(tmp_path / "x")
    run = subprocess.run([sys.executable, "-c", KILLED.format(root=root, mark=mark, path=path)], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert os.path.exists(mark) and _back(spark, path)["t"][2] == b"".join(bytes([k] * 4) for k in range(64))


@pytest.mark.parametrize("save_dtype", [None, "BF16"])
def test_merge_files(spark, tmp_path, save_dtype):
    rng = np.random.default_rng(4)
    w = {k: rng.standard_normal(s).astype("f4") for k, s in {"a": (30, 20), "b": (7,), "c": (4, 4), "nan": (3,)}.items()}
    w["nan"][1] = np.nan
    base, _ = _file(spark, tmp_path / "b", {**{f"net.{k}": ("F32", x) for k, x in w.items()}, "net.only": ("F32", [1.0]), "net.i": ("I64", np.array([1], "<i8"))})
    tuned, _ = _file(spark, tmp_path / "t", {**{f"model.diffusion_model.{k}": ("BF16", x * 1.5) for k, x in w.items()}, **{f"net.t{i}": ("F32", [2.0]) for i in range(5)}, "net.i": ("I64", np.array([9], "<i8"))})
    target, _ = _file(spark, tmp_path / "x", {"diffusion_model.a": ("F16", w["a"] + 1), "diffusion_model.b": ("F32", w["b"]), "diffusion_model.c": ("F32", np.zeros((2, 8))), "diffusion_model.nan": ("F32", w["nan"]), "diffusion_model.i": ("I64", np.array([7], "<i8")), "own": ("BF16", [3.0, 4.0])}, {"modelspec": "kept"})
    done = checkpoints.merge_files(spark, base, tuned, target, str(tmp_path / "out"), 0.5, save_dtype, chunk=100)
    got, had, t = _back(spark, tmp_path / "out"), _back(spark, target), _back(spark, tuned)
    assert list(got) == list(had)
    for k in ("diffusion_model.c", "diffusion_model.i", "own"):
        assert got[k] == had[k]
    sizes = []
    for k in ("a", "b", "nan"):
        dtype, shape, data = had[f"diffusion_model.{k}"]
        delta = safetensors.decode(t[f"model.diffusion_model.{k}"][2], "BF16") - w[k].ravel()
        want = safetensors.decode(data, dtype) + np.float32(0.5) * delta
        assert got[f"diffusion_model.{k}"] == (save_dtype or dtype, shape, safetensors.encode(want, save_dtype or dtype))
        sizes.append(np.abs(delta))
    assert done.counts == {"applied": 3, "carried": 3} and abs(done.sizes["max_delta"] - max(np.nanmax(x) for x in sizes)) < 1e-6
    assert np.isnan(done.sizes["sum_mean_delta"])
    assert done.gaps == {"base only": (1, ["only"]), "tuned only": (5, ["t0", "t1", "t2"]), "not delivered": (2, ["c", "i"])}
    notes = safetensors.metadata(str(tmp_path / "out"))
    assert notes == {"modelspec": "kept", "merged_from_target": target, "merged_delta_base": base, "merged_delta_tuned": tuned, "merged_multiplier": "0.5"}
    scaled, _ = _file(spark, tmp_path / "s", {"a.weight_scale": ("F32", [1.0])})
    with pytest.raises(ValueError, match="scaled"):
        checkpoints.merge_files(spark, base, tuned, scaled, str(tmp_path / "no"))


def test_adapter_file(spark, tmp_path):
    rng = np.random.default_rng(6)
    held = {k: x for k, (_, x) in _weights(1).items()}
    deltas = {k: rng.standard_normal((40, 3)) @ rng.standard_normal((3, 64)) for k in held}
    other = {"net.bias": ("F32", np.zeros(5)), "net.odd.weight": ("F32", np.zeros((2, 2, 2))), "net.int.weight": ("I64", np.zeros((2, 2), "<i8"))}
    base, _ = _file(spark, tmp_path / "b", {**{f"net.{k}": ("F32", x) for k, x in held.items()}, **other, "net.shape.weight": ("F32", np.zeros((2, 3)))})
    tuned, _ = _file(spark, tmp_path / "t", {**{k: ("F32", x + deltas[k]) for k, x in held.items()}, **other, "net.shape.weight": ("F32", np.zeros((3, 2)))})
    out = str(tmp_path / "out")
    energy = {r["module"]: r for r in checkpoints.adapter_file(spark, base, tuned, out, rank=4, alpha=2.0, save_dtype="F32", exclude=r"\.2\.", chunk=600, slot_bytes=1200).collect()}
    names = {k: "lora_unet_" + k.removesuffix(".weight").replace(".", "_") for k in held}
    assert set(energy) == {names["blocks.0.attn.weight"], names["blocks.1.attn.weight"]} and all(abs(r["energy"] - 1) < 1e-6 and r["rank"] == 4 for r in energy.values())
    got = _back(spark, out)
    assert list(got) == [f"{m}{x}" for m in sorted(energy) for x in (".lora_down.weight", ".lora_up.weight", ".alpha")]
    for k in ("blocks.0.attn.weight", "blocks.1.attn.weight"):
        up, down, alpha = (np.frombuffer(got[names[k] + x][2], "<f4") for x in (".lora_up.weight", ".lora_down.weight", ".alpha"))
        assert got[names[k] + ".alpha"][1] == [] and alpha == [2.0]
        assert np.abs(up.reshape(40, 4) @ down.reshape(4, 64) * (2.0 / 4) - deltas[k]).max() < 1e-4
    assert safetensors.metadata(out)["ss_network_dim"] == "4" and safetensors.metadata(out)["ss_network_alpha"] == "2"
    with pytest.raises(ValueError, match="no two-dimensional"):
        checkpoints.adapter_file(spark, base, tuned, out, include="nothing")


def test_quantised_file(spark, tmp_path):
    held = {**_weights(2, dtype="BF16"), "blocks.0.rope.weight": ("F32", np.ones((40, 64))), "final.weight": ("F32", np.linspace(0, 1, 64 * 9).reshape(9, 64)), "blocks.1.bias": ("F32", [1.0, 2.0]), "blocks.0.zero.weight": ("F32", np.zeros((9, 16)))}
    src, _ = _file(spark, tmp_path / "src", held, {"spec": "x"})
    out = str(tmp_path / "out")
    errors = checkpoints.quantise_file(spark, src, out, exclude="zero", min_gemm=0, downcast_fp32=True, report=str(tmp_path / "tsv"), chunk=700).collect()
    got, had = _back(spark, out), _back(spark, src)
    h = np.array(tensors.hadamard(64)) / 8
    for i in range(3):
        base = f"blocks.{i}.attn"
        x = safetensors.decode(had[base + ".weight"][2], "BF16").reshape(40, 64)
        dtype, shape, data = got[base + ".weight"]
        scale = np.frombuffer(got[base + ".weight_scale"][2], "<f4")[:, None]
        assert (dtype, shape, got[base + ".weight_scale"][:2]) == ("I8", [40, 64], ("F32", [40, 1]))
        assert got[base + ".comfy_quant"][2] == b'{"format": "int8_tensorwise", "convrot": true, "convrot_groupsize": 64}'
        codes = np.frombuffer(data, np.int8).reshape(40, 64)
        assert np.abs(codes).max() == 127 and np.abs((codes * scale) @ h - x).max() < 0.01
        true = 100 * np.linalg.norm((codes * scale) - x @ h) / np.linalg.norm(x)
        assert abs(next(r["relerr"] for r in errors if r["base"] == base) - true) < 1e-3
    # what stays: bytes; what is denied by its last segment or isn't a weight isn't downcast
    assert got["blocks.1.bias"] == had["blocks.1.bias"] and got["blocks.0.rope.weight"] == had["blocks.0.rope.weight"]
    assert got["final.weight"] == ("BF16", [9, 64], safetensors.encode(np.linspace(0, 1, 64 * 9).astype("f4"), "BF16"))
    assert len(errors) == 3 and [r["relerr"] for r in errors] == sorted((r["relerr"] for r in errors), reverse=True)
    assert safetensors.metadata(out) == {"spec": "x", "quantized_from": src, "quant_format": "int8_convrot"}
    lines = next((tmp_path / "tsv").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "relerr_pct\tcosine\tgroupsize\tlayer" and [x.split("\t")[3] for x in lines[1:]] == [r["base"] for r in errors] and lines[1].split("\t")[0] == f"{errors[0]['relerr']:.4f}"
    # a layer of zeros has no cosine: the run fails and no file appears
    with pytest.raises(ValueError, match="bad cosine: blocks.0.zero"):
        checkpoints.quantise_file(spark, src, str(tmp_path / "no"), min_gemm=0)
    assert not [f for f in os.listdir(tmp_path) if f.startswith("no")]


def test_runs_leave_no_tables(spark, tmp_path):
    from loomset.storage import Scratch

    with Scratch(spark) as run:
        df = run.bucketed(spark.range(10).withColumn("k", F.col("id").cast("string")), "t", "k", 4)
        assert df.count() == 10 and run.settle(df, "s").count() == 10
        folder = run.folder.removeprefix("file://")
        assert os.path.exists(folder)
    assert not os.path.exists(folder) and not [t for t in spark.catalog.listTables() if t.name.startswith("loomset_t_")]
