"""Checkpoint files in, checkpoint files out: merge, adapter extraction and 8-bit quantisation by byte ranges.

Headers decide all plans. What a plan leaves alone is copied from range to range, undecoded; what it changes is read, computed and written in ranges
of a chunk, by the task that holds the range. No tensor passes the driver or a shuffle, and files appear whole or not at all (sources.tensorfile).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions.paths import arch_stripped
from loomset.operators import lowrank, tensors
from loomset.sources import safetensors, tensorfile
from loomset.sources.safetensors import SIZES, decode, encode
from loomset.storage import Scratch

#: Bytes that a task reads of a file at once, and holds in all, about.
CHUNK, TASK = 16 << 20, 128 << 20
BYTES = "key string, at long, data binary"


def _size() -> F.Column:
    return F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])


def _numel(shape: str) -> F.Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def _spread(chunks: DataFrame, total: int) -> DataFrame:
    """Ranges dealt to tasks of about TASK bytes; the rows are plans, without data."""
    return chunks.repartition(max(1, min(100_000, -(-total // TASK))))


def _cut(rows: DataFrame, n: str, most: F.Column) -> DataFrame:
    """rows with first and count: ranges of at most `most` of their n elements or rows."""
    starts = F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1, most)).otherwise(F.array(F.lit(0).cast("long")))
    return rows.withColumn("first", F.explode(starts)).withColumn("count", F.least(most, F.col(n) - F.col("first")))


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


@dataclass
class Report:
    """What a run did: counts, and up to three examples of each kind of gap."""

    counts: dict[str, int] = field(default_factory=dict)
    sizes: dict[str, float] = field(default_factory=dict)
    gaps: dict[str, tuple[int, list[str]]] = field(default_factory=dict)


def examples(gaps: DataFrame, n: int = 3) -> DataFrame:
    """gaps (bare, gap) -> (gap, n, keys): of each kind the number, and the first n keys in order."""
    ranked = gaps.withColumn("rank", F.row_number().over(W.partitionBy("gap").orderBy("bare"))).filter(F.col("rank") <= n)
    return gaps.groupBy("gap").agg(F.count("*").alias("n")).join(ranked.groupBy("gap").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "bare"))), lambda x: x.bare).alias("keys")), "gap")


# --- merge ---


def merge_plan(base: DataFrame, tuned: DataFrame, target: DataFrame, save_dtype: str | None = None, arch: str = "auto") -> DataFrame:
    """target's header rows (key, dtype, shape, begin, ord) with out_dtype and, where a delta applies, b and t, the places and types of base and tuned."""
    side = lambda df, name: df.withColumn("bare", arch_stripped(F.col("key"), arch)).groupBy("bare").agg(F.max_by(F.struct("key", "dtype", "shape", "begin"), "key").alias(name))
    both = side(base, "b").join(side(tuned, "t"), "bare")
    out = target.withColumn("bare", arch_stripped(F.col("key"), arch)).join(both, "bare", "left")
    fits = F.coalesce(tensors.is_float(F.col("dtype")) & tensors.is_float(F.col("b.dtype")) & tensors.is_float(F.col("t.dtype")) & (F.col("b.shape") == F.col("shape")) & (F.col("t.shape") == F.col("shape")), F.lit(False))
    kept = F.lit(save_dtype) if save_dtype else F.col("dtype")
    return out.select("key", "dtype", "shape", "begin", "ord", fits.alias("applied"), F.when(fits, kept).otherwise(F.col("dtype")).alias("out_dtype"), F.when(fits, F.col("b")).alias("b"), F.when(fits, F.col("t")).alias("t"))


def merge_gaps(base: DataFrame, tuned: DataFrame, target: DataFrame, arch: str = "auto") -> DataFrame:
    """(bare, gap) of headers, as tensors.merge_gaps has it of tensors."""
    empty = F.array().cast("array<float>").alias("values")
    return tensors.merge_gaps(*[df.select("key", "dtype", "shape", empty) for df in (base, tuned, target)], arch)


def merge_files(spark: SparkSession, base: str, tuned: str, target: str, output: str, multiplier: float = 1.0, save_dtype: str | None = None, arch: str = "auto", chunk: int = CHUNK) -> Report:
    """output[k] = target[k] + multiplier * (tuned[k] - base[k]) in 32-bit floats, for keys that all three have in one shape; the rest keeps its bytes.

    save_dtype is for changed keys alone. target's metadata is carried, with where the merge came from. An output without changed keys is a copy.
    """
    heads = [tensors.refuse_scaled(safetensors.scan(spark, f)) for f in (base, tuned, target)]
    plan = merge_plan(*heads, save_dtype, arch).orderBy("ord").collect()  # a header's worth
    kind = "key string, dtype string, out_dtype string, n bigint, begin bigint, b_begin bigint, b_dtype string, t_begin bigint, t_dtype string"
    flat = [(r["key"], r["dtype"], r["out_dtype"], int(np.prod(r["shape"], dtype=np.int64)), r["begin"], *((r["b"]["begin"], r["b"]["dtype"], r["t"]["begin"], r["t"]["dtype"]) if r["applied"] else (None,) * 4)) for r in plan]
    size = F.element_at(_size(), F.greatest(F.col("dtype"), F.lit("")))
    ranges = _cut(spark.createDataFrame(flat, kind), "n", F.greatest(F.lit(chunk) / size, F.lit(1)).cast("long"))
    step = np.float32(multiplier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(target, "rb") as ft, open(base, "rb") as fb, open(tuned, "rb") as fu:
            part = lambda f, begin, dtype, r: tensorfile.fetch(f, begin + r["first"] * SIZES[dtype], r["count"] * SIZES[dtype])
            for r in (r for b in batches for r in b.to_pylist()):
                data, most, mean = part(ft, r["begin"], r["dtype"], r), None, None
                if r["b_dtype"]:
                    with np.errstate(all="ignore"):
                        delta = decode(part(fu, r["t_begin"], r["t_dtype"], r), r["t_dtype"]) - decode(part(fb, r["b_begin"], r["b_dtype"], r), r["b_dtype"])
                        data = encode(decode(data, r["dtype"]) + step * delta, r["out_dtype"])
                        large = np.abs(delta)
                        most, mean = float(np.fmax.reduce(large, initial=np.float32(0))), float(large.sum(dtype=np.float64)) / max(1, r["n"])
                yield _batch(["key", "at", "data", "most", "mean"], [pa.string(), pa.int64(), pa.binary(), pa.float64(), pa.float64()], [(r["key"], r["first"] * SIZES[r["out_dtype"]], data, most, mean)])

    made = _spread(ranges, os.path.getsize(target)).mapInArrow(run, BYTES + ", most double, mean double")
    seen = Observation()
    made = made.observe(seen, F.max("most").alias("max_delta"), F.sum("mean").alias("sum_mean_delta"))
    notes = {**safetensors.metadata(target), "merged_from_target": target, "merged_delta_base": base, "merged_delta_tuned": tuned, "merged_multiplier": f"{multiplier:g}"}
    tensorfile.write(made, output, [(r["key"], r["out_dtype"], r["shape"]) for r in plan], notes)
    sizes = {k: v or 0.0 for k, v in seen.get.items()}
    applied = sum(r["applied"] for r in plan)
    gaps = {r["gap"]: (r["n"], r["keys"]) for r in examples(merge_gaps(*heads, arch)).collect()}
    return Report({"applied": applied, "carried": len(plan) - applied}, {**sizes, "negligible": sizes["max_delta"] < 1e-4}, gaps)


# --- adapters ---


def adapter_file(spark: SparkSession, base: str, tuned: str, output: str, rank: int = 32, alpha: float | None = None, save_dtype: str = "F16", arch: str = "auto", include: str | None = None, exclude: str | None = None, niter: int = 2, oversample: int = 8, chunk: int = CHUNK, slot_bytes: int = lowrank.SLOT) -> DataFrame:
    """An adapter file of the eligible weights of both checkpoints, and (module, rank, energy). Fails if none is eligible."""
    if rank < 1:
        raise ValueError("the rank must be 1 or more")
    heads = [tensors.refuse_scaled(safetensors.scan(spark, f)) for f in (base, tuned)]
    modules = tensors.lora_pairs(*heads, include, exclude, arch).orderBy("module").collect()
    if not modules:
        raise ValueError("no two-dimensional float weights of one shape in both files")
    shapes = {r["module"]: [int(x) for x in r["shape"]] for r in modules}
    flat = [(r["module"], *shapes[r["module"]], r["b"]["begin"], r["b"]["dtype"], r["t"]["begin"], r["t"]["dtype"]) for r in modules]
    cut = _cut(spark.createDataFrame(flat, "module string, n bigint, width int, b_begin bigint, b_dtype string, t_begin bigint, t_dtype string"), "n", F.greatest(F.lit(chunk) / (4 * F.greatest("width", F.lit(1))), F.lit(1)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(base, "rb") as fb, open(tuned, "rb") as ft:
            part = lambda f, begin, dtype, r: decode(tensorfile.fetch(f, begin + r["first"] * r["width"] * SIZES[dtype], r["count"] * r["width"] * SIZES[dtype]), dtype)
            for r in (r for b in batches for r in b.to_pylist()):
                delta = part(ft, r["t_begin"], r["t_dtype"], r) - part(fb, r["b_begin"], r["b_dtype"], r)
                slot = r["first"] * r["width"] * 4 // max(1, slot_bytes)
                yield _batch(["module", "slot", "ids", "width", "delta"], [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()], [(r["module"], slot, list(range(r["first"], r["first"] + r["count"])), r["width"], delta.astype("<f4").tobytes())])

    slots = sum(1 + n * w * 4 // max(1, slot_bytes) for n, w in shapes.values())
    blocks = _spread(cut, sum(n * w * 8 for n, w in shapes.values())).mapInArrow(run, lowrank.BLOCKS)
    basis, up = lowrank.factored(blocks, rank, oversample, niter, finish=lowrank.up_blocks(alpha), buckets=min(4096, max(lowrank.BUCKETS, slots)))
    ranks = {m: min(rank, *s) for m, s in shapes.items()}
    each = SIZES[save_dtype]

    def ups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            yield _batch(["key", "at", "data"], [pa.string(), pa.int64(), pa.binary()], [(r["module"] + ".lora_up.weight", r["ids"][0] * r["rank"] * each, encode(np.frombuffer(r["up"], "<f4"), save_dtype))])

    def downs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            rows = [(r["module"] + ".lora_down.weight", r["row"] * len(r["values"]) * each, encode(np.asarray(r["values"], "f4"), save_dtype))]
            rows += [(r["module"] + ".alpha", 0, encode(np.array([r["alpha"]], "f4"), save_dtype))] if r["row"] == 0 else []
            yield _batch(["key", "at", "data"], [pa.string(), pa.int64(), pa.binary()], rows)

    plan = [t for m, (n, w) in sorted(shapes.items()) for t in ((f"{m}.lora_down.weight", save_dtype, [ranks[m], w]), (f"{m}.lora_up.weight", save_dtype, [n, ranks[m]]), (f"{m}.alpha", save_dtype, []))]
    notes = {"ss_network_module": "networks.lora", "ss_network_dim": str(rank), "ss_network_alpha": f"{rank if alpha is None else alpha:g}", "lora_extracted_from_base": base, "lora_extracted_from_tuned": tuned}
    tensorfile.write(up.mapInArrow(ups, BYTES).unionByName(lowrank.down_rows(basis, alpha).mapInArrow(downs, BYTES)), output, plan, notes)
    return basis.select("module", "rank", "energy")


# --- quantisation ---


def quant_plan(head: DataFrame, include: str | None = None, exclude: str | None = None, min_gemm: int = 256, downcast_fp32: bool = False, deny_mode: str = "effective") -> DataFrame:
    """Header rows with action (keep, downcast or quantise), base, gs and reason (null for what isn't a weight)."""
    weight = F.endswith(F.col("key"), F.lit(".weight"))
    base = F.regexp_replace("key", r"\.weight$", "")
    planned = tensors.downcasts(tensors.layer_plan(head.filter(weight).withColumn("base", base), include, exclude, min_gemm, deny_mode), deny_mode)
    action = F.when(F.col("gs").isNotNull(), "quantise").when(F.col("downcast") & F.lit(downcast_fp32), "downcast").otherwise("keep")
    rest = head.filter(~weight).select("*", F.lit("keep").alias("action"), F.lit(None).cast("string").alias("base"), F.lit(None).cast("int").alias("gs"), F.lit(None).cast("string").alias("reason"))
    return planned.withColumn("action", action).select(*head.columns, "action", "base", "gs", "reason").unionByName(rest)


ERRORS = "base string, gs int, relerr double, cosine double"
_SUMS = ("err2", "ref2", "dot", "dec2")


def quantise_file(spark: SparkSession, src: str, output: str, include: str | None = None, exclude: str | None = None, min_gemm: int = 256, downcast_fp32: bool = False, least_cosine: float = 0.99, deny_mode: str = "effective", report: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """A file with planned layers rotated and quantised to 8 bits (codes, a scale for each row, settings), and ERRORS, worst first.

    Other tensors keep their bytes, or become 16-bit floats of the commoner kind where downcast_fp32 asks for it. If a layer's cosine isn't above
    least_cosine the run fails and no file appears. report: a folder for the errors as TSV.
    """
    head = tensors.refuse_scaled(safetensors.scan(spark, src))
    small = tensors.compute_dtype(head).first()["dtype"]
    plan = quant_plan(head, include, exclude, min_gemm, downcast_fp32, deny_mode).orderBy("ord").collect()
    out, flat, settings = [], [], []
    for r in plan:
        n = r["shape"][0] if r["shape"] else 1
        if r["action"] == "quantise":
            text = json.dumps({"format": "int8_tensorwise", "convrot": True, "convrot_groupsize": r["gs"]})
            out += [(r["key"], "I8", r["shape"]), (f"{r['base']}.weight_scale", "F32", [n, 1]), (f"{r['base']}.comfy_quant", "U8", [len(text)])]
            settings.append((f"{r['base']}.comfy_quant", 0, text.encode()))
        else:
            out.append((r["key"], small if r["action"] == "downcast" else r["dtype"], r["shape"]))
        flat.append((r["key"], r["action"], r["base"], r["gs"], r["dtype"], n, int(np.prod(r["shape"][1:], dtype=np.int64)), r["begin"]))
    kind = "key string, action string, base string, gs int, dtype string, n bigint, width bigint, begin bigint"
    ranges = _cut(spark.createDataFrame(flat, kind), "n", F.greatest(F.lit(chunk) / F.greatest(F.col("width") * F.element_at(_size(), F.col("dtype")), F.lit(1)), F.lit(1)).cast("long"))

    def fetched(f, r: dict) -> bytes:
        row = r["width"] * SIZES[r["dtype"]]
        return tensorfile.fetch(f, r["begin"] + r["first"] * row, r["count"] * row)

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        with open(src, "rb") as f:
            for r in (r for b in batches for r in b.to_pylist()):
                h = turns.setdefault(r["gs"], np.array(tensors.hadamard(r["gs"])) / r["gs"] ** 0.5)
                x = (decode(fetched(f, r), r["dtype"]).astype(np.float64).reshape(-1, r["gs"]) @ h).reshape(r["count"], r["width"])
                single = x.astype("f4")
                scale = np.maximum(np.maximum(np.abs(single).max(axis=1), np.float32(1e-30)) / np.float32(127), np.float32(1e-30))
                codes = np.clip(np.rint(single / scale[:, None]), -127, 127).astype(np.int8)
                back = (codes.astype("f4") * scale[:, None]).astype(np.float64)
                sums = (((x - back) ** 2).sum(), (x * x).sum(), (x * back).sum(), (back * back).sum())
                yield _batch(["key", "base", "gs", "first", "width", "codes", "scales", *_SUMS], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.float64()] * 4], [(r["key"], r["base"], r["gs"], r["first"], r["width"], codes.tobytes(), scale.astype("<f4").tobytes(), *map(float, sums))])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(src, "rb") as f:
            for r in (r for b in batches for r in b.to_pylist()):
                data = fetched(f, r)
                dtype = small if r["action"] == "downcast" else r["dtype"]
                yield _batch(["key", "at", "data"], [pa.string(), pa.int64(), pa.binary()], [(r["key"], r["first"] * r["width"] * SIZES[dtype], encode(decode(data, r["dtype"]), dtype) if r["action"] == "downcast" else data)])

    total = os.path.getsize(src)
    with Scratch(spark) as run:
        made = run.settle(_spread(ranges.filter("action = 'quantise'"), total).mapInArrow(quantised, "key string, base string, gs int, first long, width long, codes binary, scales binary, err2 double, ref2 double, dot double, dec2 double"), "codes")
        errors = tensors.worst(tensors.layer_errors(made, ["base", "gs"]), 1 << 30).collect()  # a row for each layer of a header
        bad = [r for r in errors if not r["cosine"] > least_cosine]
        if bad:
            raise ValueError(f"bad cosine: {bad[0]['base']} has {bad[0]['cosine']:.5f}")
        codes = made.select("key", (F.col("first") * F.col("width")).alias("at"), F.col("codes").alias("data"))
        scales = made.select(F.concat("base", F.lit(".weight_scale")).alias("key"), (F.col("first") * 4).alias("at"), F.col("scales").alias("data"))
        rest = _spread(ranges.filter("action <> 'quantise'"), total).mapInArrow(carried, BYTES)
        parts = codes.unionByName(scales).unionByName(rest).unionByName(spark.createDataFrame(settings, BYTES))
        tensorfile.write(parts, output, out, {**safetensors.metadata(src), "quantized_from": src, "quant_format": "int8_convrot"})
    found = spark.createDataFrame([(r["base"], r["gs"], r["relerr"], r["cosine"]) for r in errors], ERRORS)
    if report:
        from loomset.sources.sinks import write_verify_report

        write_verify_report(found.coalesce(1), report)
    return found
