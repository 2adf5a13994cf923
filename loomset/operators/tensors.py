"""Checkpoint tensors as rows: weight-delta merges, low-rank extraction, and rotated 8-bit quantisation.

Elementwise work is array expressions over float columns. Factors of matrices are in lowrank, whole files in checkpoints.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.paths import arch_stripped, digits_collapsed, lora_name

#: Float types that are computed with, and rotation group sizes by preference.
FLOATS = ("F64", "F32", "F16", "BF16")
GROUPS = (256, 64, 16)
#: Segments of layer names that are never quantised. `effective` is what matches in practice, `intended` what is documented.
DENY = {
    "effective": r"scale_shift|rope|rotary|rel_pos|pos_?embed|embedder|router|routing|logit|temperature|temb|t_emb|guidance|register|refiner_blocks|adapter",
    "intended": r"scale_shift|rope|rotary|rel_pos|pos_?embed|embedder|gate_logits|router|routing|logit|temperature|(?:^|_)time|temb|t_emb|guidance|register|refiner_blocks|adapter|(?:^|_)(?:final|head|proj_out|out_layer)(?:_|$)",
}
#: Fixed value: the name of the reason of a denied segment.
DENIED = "denylist(scale_shift/embed/gate/time/head/refiner_blocks/adapter)"
#: Rows of header entries, of either side, that a task sorts.
ROWS = 1 << 17


def is_float(dtype: Column) -> Column:
    return dtype.isin(*FLOATS)


def refuse_scaled(tensors: DataFrame) -> DataFrame:
    """Fails if the file holds scales of 8-bit floats."""
    bad = tensors.filter(F.col("key").rlike(r"(_scale|\.scale_weight)$")).limit(1).count()
    if bad:
        raise ValueError("the checkpoint is fp8-scaled; dequantise it first")
    return tensors


def _bare(tensors: DataFrame, arch: str, name: str) -> DataFrame:
    """One row for each bare key, the last in order of key."""
    return tensors.withColumn("bare", arch_stripped(F.col("key"), arch)).groupBy("bare").agg(F.max_by(F.struct("key", "dtype", "shape", "values"), "key").alias(name))


def delta(base: Column, tuned: Column) -> Column:
    return F.zip_with(base, tuned, lambda b, t: t - b)


def merge_diff(base: DataFrame, tuned: DataFrame, target: DataFrame, multiplier: float = 1.0, arch: str = "auto") -> DataFrame:
    """target's tensors plus multiplier * (tuned - base), matched by bare key: values, applied, and the delta's largest and mean size.

    All in 32-bit floats. Tensors without a float delta of the same shape pass through.
    """
    deltas = _bare(base, arch, "b").join(_bare(tuned, arch, "t"), "bare").filter(is_float(F.col("b.dtype")) & is_float(F.col("t.dtype")) & (F.col("b.shape") == F.col("t.shape")))
    deltas = deltas.select("bare", F.col("b.shape").alias("delta_shape"), delta(F.col("b.values"), F.col("t.values")).alias("delta"))
    out = target.withColumn("bare", arch_stripped(F.col("key"), arch)).join(deltas, "bare", "left")
    fits = F.coalesce(is_float(F.col("dtype")) & (F.col("shape") == F.col("delta_shape")), F.lit(False))
    sizes = F.filter(F.transform("delta", lambda d: F.abs(d)), lambda d: ~F.isnan(d))
    return out.select(
        "key", "dtype", "shape", F.when(fits, F.zip_with("values", "delta", lambda x, d: (x + F.lit(multiplier).cast("float") * d).cast("float"))).otherwise(F.col("values")).alias("values"),
        fits.alias("applied"), F.when(fits, F.array_max(sizes)).alias("max_delta"), F.when(fits, F.aggregate("delta", F.lit(0.0), lambda a, d: a + F.abs(d).cast("double")) / F.size("delta")).alias("mean_delta"),
    )


def merge_stats(merged: DataFrame) -> DataFrame:
    """max |delta| without NaN, sum over keys of mean |delta|, applied and carried counts, and whether the delta is negligible."""
    return merged.agg(F.max("max_delta").alias("max_delta"), F.sum("mean_delta").alias("sum_mean_delta"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("carried")).withColumn("negligible", F.col("max_delta") < F.lit(1e-4).cast("float"))


def merge_gaps(base: DataFrame, tuned: DataFrame, target: DataFrame, arch: str = "auto") -> DataFrame:
    """(bare, gap): keys of one side alone, and shared ones that the target has not in that form."""
    b, t = _bare(base, arch, "b"), _bare(tuned, arch, "t")
    only = b.join(t, "bare", "left_anti").select("bare", F.lit("base only").alias("gap")).unionByName(t.join(b, "bare", "left_anti").select("bare", F.lit("tuned only").alias("gap")))
    to = target.withColumn("bare", arch_stripped(F.col("key"), arch)).filter(is_float(F.col("dtype"))).select("bare", F.col("shape").alias("to"))
    shared = b.join(t, "bare").select("bare", F.col("b.shape").alias("shape")).alias("s")
    lost = shared.join(to.alias("o"), (F.col("s.bare") == F.col("o.bare")) & (F.col("s.shape") == F.col("o.to")), "left_anti").select("bare", F.lit("not delivered").alias("gap"))
    return only.unionByName(lost)


# --- quantisation ---


def layer_plan(layers: DataFrame, include: str | None = None, exclude: str | None = None, min_gemm: int = 256, deny_mode: str = "effective") -> DataFrame:
    """layers (base, shape) with gs (null if skipped) and reason. The order of rules matters: exclusion beats classification, inclusion both, size comes last."""
    shape, base = F.col("shape"), F.col("base")
    n, k = F.try_element_at("shape", F.lit(1)), F.try_element_at("shape", F.lit(2))
    best = F.coalesce(*[F.when(k % g == 0, F.lit(g)) for g in GROUPS])
    segments = F.split(base, r"\.")
    indexed = F.exists(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: s.rlike("^[0-9]+$"))
    fits = (F.size(shape) == 2) & (n >= 8) & best.isNotNull()
    reason = (
        F.when(F.size(shape) != 2, "not-2d").when(n < 8, "small-N").when(best.isNull(), "ineligible-K").when(~indexed, "not-in-indexed-block")
        .when(F.exists(segments, lambda s: s.rlike(DENY[deny_mode])), DENIED)
    )
    if exclude:
        reason = F.when(base.rlike(exclude), "excluded(flag)").otherwise(reason)
    if include:
        reason = F.when(base.rlike(include) & fits, F.lit(None)).otherwise(reason)
    if min_gemm > 0:
        reason = F.when(reason.isNull() & (F.least(n, k) < min_gemm), "below-min-gemm").otherwise(reason)
    return layers.withColumn("reason", reason).withColumn("gs", F.when(F.col("reason").isNull(), best))


def plan_report(plan: DataFrame) -> DataFrame:
    """For each pattern of names and group size: layers and parameters."""
    return plan.filter("gs IS NOT NULL").groupBy(digits_collapsed(F.col("base")).alias("pattern"), "gs").agg(F.count("*").alias("n"), F.min(F.concat_ws("x", "shape")).alias("shape"), F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)).alias("params"))


def skip_reasons(plan: DataFrame) -> DataFrame:
    return plan.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def compute_dtype(tensors: DataFrame) -> DataFrame:
    """The commoner of the 16-bit types among weights."""
    w = tensors.filter(F.endswith(F.col("key"), F.lit(".weight")))
    return w.agg(F.count_if(F.col("dtype") == "F16").alias("f16"), F.count_if(F.col("dtype") == "BF16").alias("bf16")).select(F.when((F.col("f16") >= F.col("bf16")) & (F.col("f16") > 0), "F16").otherwise("BF16").alias("dtype"))


def downcasts(plan: DataFrame, deny_mode: str = "effective") -> DataFrame:
    """Skipped 32-bit weights that may be stored in 16 bits: not scales, nor denied by their last segment."""
    last = F.element_at(F.split("base", r"\."), -1)
    return plan.withColumn("downcast", F.col("reason").isNotNull() & (F.col("dtype") == "F32") & ~F.endswith(F.col("base"), F.lit(".scale")) & ~last.rlike(DENY[deny_mode]))


def quant_json(gs: Column) -> Column:
    return F.format_string('{"format": "int8_tensorwise", "convrot": true, "convrot_groupsize": %d}', gs)


def hadamard(size: int) -> list[list[float]]:
    h = [[1.0]]
    while len(h) < size:
        h = [[a * (-1.0 if p + q == 3 else 1.0) for q in range(4) for a in row] for p in range(4) for row in h]
    return h


def rotate(values: Column, gs: int) -> Column:
    """values times the block-Hadamard matrix of each group, over the square root of its size, in doubles. A batch of rows is one matrix product."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        import numpy as np

        if not len(rows):
            return rows
        h = np.array(hadamard(gs)) / gs**0.5
        flat = np.concatenate([np.asarray(r, np.float64) for r in rows])
        ends = np.cumsum([len(r) for r in rows])[:-1]
        return pd.Series(np.split((flat.reshape(-1, gs) @ h).ravel(), ends))

    return run(values)


def quantise(rows: DataFrame, values: str = "values") -> DataFrame:
    """rows with scale, codes (-127 to 127), and the sums that errors follow from: squared error, squared size, dot product, squared decoded size."""
    v = F.col(values)
    amax = F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x).cast("float"))), F.lit(1e-30).cast("float"))
    scale = F.greatest((amax / F.lit(127.0).cast("float")).cast("float"), F.lit(1e-30).cast("float"))
    held = rows.withColumn("scale", scale)
    codes = F.transform(v, lambda x: F.greatest(F.least(F.rint((x.cast("float") / F.col("scale")).cast("float")), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))
    held = held.withColumn("codes", codes)
    decoded = lambda q: (q.cast("float") * F.col("scale")).cast("float")
    total = lambda f: F.aggregate(F.zip_with(v, "codes", f), F.lit(0.0), lambda a, x: a + x)
    d = lambda x: x.cast("double")
    return (
        held.withColumn("err2", total(lambda x, q: (d(x) - d(decoded(q))) * (d(x) - d(decoded(q))))).withColumn("ref2", total(lambda x, q: d(x) * d(x)))
        .withColumn("dot", total(lambda x, q: d(x) * d(decoded(q)))).withColumn("dec2", total(lambda x, q: d(decoded(q)) * d(decoded(q))))
    )


def gs_histogram(plan: DataFrame) -> DataFrame:
    """Layers of each group size."""
    return plan.filter("gs IS NOT NULL").groupBy("gs").agg(F.count("*").alias("n"))


def int8(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (base, row, values) of the layers that the plan (base, gs) takes, rotated in groups of gs and quantised: gs, scale, codes and quantise's sums added.

    A layer is as many rows as its matrix has, so large layers spread over tasks; the plan has a row for each layer and is joined to them.
    """
    taken = rows.join(plan.filter("gs IS NOT NULL").select("base", "gs"), "base")
    turned = [taken.filter(F.col("gs") == g).withColumn("turned", rotate(F.col("values"), g)) for g in GROUPS]
    both = turned[0]
    for more in turned[1:]:
        both = both.unionByName(more)
    return quantise(both, "turned").drop("turned")


def int8_tensors(quantised: DataFrame) -> DataFrame:
    """What is written of quantised rows: (key, dtype, row, values): of each row its codes as I8 and its scale as F32, and of each layer the settings' bytes as U8, with row null."""
    named = lambda end, dtype, row, values: (F.concat("base", F.lit(end)).alias("key"), F.lit(dtype).alias("dtype"), row.alias("row"), values.cast("array<float>").alias("values"))
    codes = quantised.select(*named(".weight", "I8", F.col("row"), F.col("codes")))
    scales = quantised.select(*named(".weight_scale", "F32", F.col("row"), F.array("scale")))
    text = quant_json(F.col("gs"))
    settings = quantised.groupBy("base").agg(F.first("gs").alias("gs")).select(*named(".comfy_quant", "U8", F.lit(None).cast("long"), F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))))
    return codes.unionByName(scales).unionByName(settings)


def errors_by_gs(errors: DataFrame) -> DataFrame:
    """errors (gs, relerr) -> for each group size the mean, the largest and the number of layers."""
    return errors.groupBy("gs").agg(F.avg("relerr").alias("mean"), F.max("relerr").alias("max"), F.count("*").alias("n"))


def layer_errors(quantised: DataFrame, by: list[str]) -> DataFrame:
    """Relative error in percent and cosine of each layer, from its rows' sums."""
    sums = quantised.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("err2", "ref2", "dot", "dec2")])
    return sums.select(*by, (100 * F.sqrt(F.col("err2")) / F.greatest(F.sqrt("ref2"), F.lit(1e-30))).alias("relerr"), (F.col("dot") / F.greatest(F.sqrt(F.col("ref2") * F.col("dec2")), F.lit(1e-30))).alias("cosine"))


def error_report(errors: DataFrame, warn: float = 2.0) -> DataFrame:
    return errors.agg(F.avg("relerr").alias("mean"), F.min("relerr").alias("min"), F.max("relerr").alias("max"), F.count_if(F.col("relerr") > warn).alias("n_over"), F.count("*").alias("n"))


def worst(errors: DataFrame, n: int = 8) -> DataFrame:
    return errors.orderBy(F.desc("relerr"), *[c for c in errors.columns if c not in ("relerr", "cosine")]).limit(n)


def refuse_bad(errors: DataFrame, least: float = 0.99) -> DataFrame:
    """Fails while running if a layer's cosine is not above `least`."""
    return errors.withColumn("cosine", F.when(F.assert_true(F.col("cosine") > least, F.concat(F.lit("bad cosine: "), F.col("cosine").cast("string"))).isNull(), F.col("cosine")))


# --- low rank: which weights, and their deltas (factors: lowrank) ---


def tasks(rows: int) -> int:
    """Tasks for so many rows of header entries."""
    return max(1, -(-rows // ROWS))


def lora_pairs(base: DataFrame, tuned: DataFrame, include: str | None = None, exclude: str | None = None, arch: str = "auto") -> DataFrame:
    """(module, bare, shape, b, t): the two-dimensional weights of both sides, of one shape and a float type on the base's side, that the patterns leave. b and t hold the other columns of either side."""
    n = tasks(max(base.count(), tuned.count()))  # whole keys are sorted, in parts whose size doesn't follow the input's
    side = lambda df, name: df.withColumn("bare", arch_stripped(F.col("key"), arch)).repartition(n, "bare").groupBy("bare").agg(F.max_by(F.struct(*df.columns), "key").alias(name))
    both = side(base, "b").hint("merge").join(side(tuned, "t"), "bare")  # a broadcast side would follow the input
    ok = F.endswith(F.col("bare"), F.lit(".weight")) & is_float(F.col("b.dtype")) & (F.size("b.shape") == 2) & (F.col("b.shape") == F.col("t.shape"))
    if include:
        ok = ok & F.col("bare").rlike(include)
    if exclude:
        ok = ok & ~F.col("bare").rlike(exclude)
    return both.filter(ok).select(lora_name(F.col("bare")).alias("module"), "bare", F.col("b.shape").alias("shape"), "b", "t")


def lora_modules(base: DataFrame, tuned: DataFrame, include: str | None = None, exclude: str | None = None, arch: str = "auto") -> DataFrame:
    """(module, shape, delta) of lora_pairs."""
    return lora_pairs(base, tuned, include, exclude, arch).select("module", "shape", delta(F.col("b.values"), F.col("t.values")).alias("delta"))


def lora_rows(modules: DataFrame) -> DataFrame:
    """lora_modules as (module, row, delta), a row of a matrix each."""
    width = F.col("shape")[1].cast("int")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shape")[0] - 1))
    return modules.filter((F.col("shape")[0] > 0) & (F.col("shape")[1] > 0)).select("module", each.alias("row"), "shape", "delta").select("module", "row", F.slice("delta", (F.col("row") * width + 1).cast("int"), width).alias("delta"))


def delta_rows(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(module, row, values) of both sides, a row of a matrix each -> (module, row, delta), where both have the row in one width."""
    b, t = (x.select("module", "row", F.col("values").alias(c)) for x, c in ((base, "b"), (tuned, "t")))
    return b.join(t, ["module", "row"]).filter(F.size("b") == F.size("t")).select("module", "row", delta(F.col("b"), F.col("t")).alias("delta"))


def module_norms(rows: DataFrame) -> DataFrame:
    """rows (module, row, delta) -> (module, rows, width, norm2: the squared size)."""
    squares = F.aggregate("delta", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.groupBy("module").agg(F.count("*").alias("rows"), F.max(F.size("delta")).alias("width"), F.sum(squares).alias("norm2"))
