"""Queries that write checkpoint files of the embeddings, work on them file to file, and read the outcome back; with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import checkpoints, lowrank, tensors
from loomset.plans.derive import table
from loomset.plans.tensor_queries import _H, _layers, _three
from loomset.sources import safetensors
from loomset.storage import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can open as a path."""
    place = shared_dir(spark)
    if not place.startswith(("file:", "/")):
        raise ValueError(f"checkpoint files need a shared folder with a path, not {place}")
    out = f"/{place.removeprefix('file:').lstrip('/')}/loomset/files-{uuid.uuid4().hex}"
    os.makedirs(out)
    return out


def _file(rows: DataFrame, path: str, key: Column, dtype: Column, row: Column, values: Column, extra: dict[str, str] | None = None) -> str:
    """Matrices of 64 columns from rows (key, dtype, row, values)."""
    named = rows.select(key.alias("key"), dtype.alias("dtype"), row.cast("long").alias("row"), values.alias("values"))
    shapes = named.groupBy("key").agg(F.array(F.count("*"), F.lit(64).cast("long")).alias("shape"), F.lit(0).alias("ord"))
    safetensors.write(safetensors.encoded(named.join(shapes, "key"), F.col("dtype")), path, extra)
    return path


def _vectors(spark, d: str) -> DataFrame:
    """Every 64 vectors are a tensor, k, of which they are the rows."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 64).alias("k"), (F.col("vec_id") % 64).alias("row"), F.col("embedding").cast("array<float>").alias("v"))


_K = "(vec_id // 64)"
_KINDS = f"CASE WHEN {_K} % 3 = 0 THEN 'F32' WHEN {_K} % 3 = 1 THEN 'BF16' ELSE 'F16' END"


def _name(prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}blocks."), F.col("k").cast("string"), F.lit(".w.weight"))


@query("tensor_ranges", f"SELECT 'net.blocks.' || {_K} || '.w.weight' AS tensor, vec_id // 16 % 4 * 16 AS row_no, count(*)::BIGINT AS n_rows, round(sum(list_sum(list_transform(embedding::FLOAT[], lambda x: x::DOUBLE))), 6) AS total FROM embeddings WHERE {_KINDS} = 'F32' GROUP BY ALL")
def tensor_ranges(spark, d: str) -> DataFrame:
    """Tensors of one type, read in ranges of 16 rows; the others' bytes aren't read."""
    kind = F.when(F.col("k") % 3 == 0, "F32").when(F.col("k") % 3 == 1, "BF16").otherwise("F16")
    path = _file(_vectors(spark, d), f"{_folder(spark)}/e", _name("net."), kind, F.col("row"), F.col("v"))
    held = safetensors.decoded(safetensors.read(spark, path, F.col("dtype") == "F32", chunk_bytes=16 * 64 * 4))
    return held.select(F.col("key").alias("tensor"), F.col("row").alias("row_no"), F.col("rows").alias("n_rows"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("merge_file", """WITH t AS (
  SELECT (vec_id // 64) AS k, (vec_id // 64) % 4 <> 3 AS applied, CASE WHEN (vec_id // 64) % 4 <> 3 THEN 'F32' ELSE CASE WHEN (vec_id // 64) % 3 = 0 THEN 'F32' ELSE 'F16' END END AS dtype, unnest(embedding::FLOAT[]) AS x FROM embeddings
), m AS (SELECT *, CASE WHEN applied THEN (x + (0.5::FLOAT * (((x * 1.25::FLOAT)::FLOAT - x)::FLOAT))::FLOAT)::FLOAT ELSE x END AS y FROM t WHERE dtype = 'F32' AND (applied OR k % 3 = 0))
SELECT 'model.diffusion_model.blocks.' || k || '.w.weight' AS tensor, dtype, round(sum(y::DOUBLE), 4) AS total, max(y) AS largest, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def merge_file(spark, d: str) -> DataFrame:
    """Three checkpoint files merged into a fourth: changed tensors become F32, the others keep their bytes (F16 ones aren't compared in SQL)."""
    at, e = _folder(spark), _vectors(spark, d)
    grown = F.transform("v", lambda x: (x * F.lit(1.25).cast("float")).cast("float"))
    base = _file(e, f"{at}/base", _name("net."), F.lit("F32"), F.col("row"), F.col("v"))
    tuned = _file(e.filter("k % 4 <> 3"), f"{at}/tuned", _name("diffusion_model."), F.lit("F32"), F.col("row"), grown)
    exact = F.when(F.col("k") % 4 != 3, "F32").when(F.col("k") % 3 == 0, "F32").otherwise("F16")
    target = _file(e, f"{at}/target", _name("model.diffusion_model."), exact, F.col("row"), F.col("v"))
    checkpoints.merge_files(spark, base, tuned, target, f"{at}/merged", 0.5, "F32", chunk=1 << 12)
    out = safetensors.decoded(safetensors.read(spark, f"{at}/merged", F.col("dtype") == "F32", chunk_bytes=1 << 12)).select("key", "dtype", F.explode("values").alias("y"))
    return out.groupBy(F.col("key").alias("tensor"), "dtype").agg(F.round(F.sum(F.col("y").cast("double")), 4).alias("total"), F.max("y").alias("largest"), F.count("*").alias("n"))


@query("merge_gap_examples", """WITH g AS (SELECT 'w' || vec_id AS bare, 'base only' AS gap FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT 'w' || vec_id, 'not delivered' FROM embeddings WHERE vec_id % 7 <> 0 AND (vec_id % 13 = 0 OR vec_id % 11 = 0 OR vec_id::VARCHAR LIKE '%5')),
r AS (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY bare) AS k, count(*) OVER (PARTITION BY gap)::BIGINT AS n FROM g) SELECT gap, n, string_agg(bare, ',' ORDER BY bare) AS first_keys FROM r WHERE k <= 3 GROUP BY gap, n""")
def merge_gap_examples(spark, d: str) -> DataFrame:
    """The number of keys in each kind of gap, and the first three."""
    return checkpoints.examples(tensors.merge_gaps(*_three(spark, d))).select("gap", "n", F.array_join("keys", ",").alias("first_keys"))


@query("quant_file", _H.replace("'blocks.' || label || '.w' AS base", f"'blocks.' || {_K} || '.w' AS base") + f"""SELECT base || '.weight' AS tensor, vec_id % 64 AS row_no, array_to_string(codes, ',') AS content FROM q
UNION ALL SELECT base || '.comfy_quant', 0, '{{"format": "int8_tensorwise", "convrot": true, "convrot_groupsize": 64}}' FROM (SELECT DISTINCT base FROM q)
UNION ALL SELECT base || '.weight_scale', vec_id % 64, round(scale::DOUBLE, 8)::DECIMAL(12, 8)::VARCHAR FROM q""")
def quant_file(spark, d: str) -> DataFrame:
    """A checkpoint file of all vectors, quantised to another and read back row by row."""
    at = _folder(spark)
    src = _file(_vectors(spark, d), f"{at}/src", _name(""), F.lit("F32"), F.col("row"), F.col("v"))
    checkpoints.quantise_file(spark, src, f"{at}/int8", min_gemm=0, chunk=1 << 12)
    held = safetensors.read(spark, f"{at}/int8", chunk_bytes=64)
    signed = lambda x: F.when(x > 127, x - 256).otherwise(x).cast("string")
    codes = F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: signed(F.conv(F.hex(F.substr("data", i, F.lit(1))), 16, 10).cast("int"))), ",")
    weights = held.filter("dtype = 'I8'").select(F.col("key").alias("tensor"), F.col("row").alias("row_no"), codes.alias("content"))
    settings = held.filter("dtype = 'U8'").groupBy(F.col("key").alias("tensor")).agg(F.decode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "data"))), lambda x: F.decode(x.data, "UTF-8")), "").cast("binary"), "UTF-8").alias("content"))
    scales = safetensors.decoded(held.filter("dtype = 'F32'")).select(F.col("key").alias("tensor"), F.posexplode("values").alias("i", "x"), "row").select("tensor", (F.col("row") + F.col("i")).alias("row_no"), F.round(F.col("x").cast("double"), 8).cast("decimal(12,8)").cast("string").alias("content"))
    return weights.unionByName(settings.select("tensor", F.lit(0).cast("long").alias("row_no"), "content")).unionByName(scales)


def _known(spark, d: str) -> DataFrame:
    """A module for each label, whose rows have one entry each, at vec_id % 64, that shrinks with its place: columns are orthogonal, so their lengths are the singular values."""
    e = table(spark, d, "embeddings")
    at = F.col("vec_id") % 64
    entry = lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(j == at, v).otherwise(0.0).cast("float"))
    return e.select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("module"), F.col("vec_id").alias("row"), entry((1 + F.abs(F.col("embedding")[0])) * F.pow(F.lit(0.5), at)).alias("delta"))


_KNOWN = """WITH x AS (SELECT 'm' || label AS module, vec_id AS row_no, vec_id % 64 AS j, ((1 + abs(embedding[1]))::DOUBLE * 0.5::DOUBLE ** (vec_id % 64))::FLOAT::DOUBLE AS x FROM embeddings),
n AS (SELECT module, j, sqrt(sum(x * x)) AS s FROM x GROUP BY module, j), r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY s DESC) AS k FROM n)
"""


@query("lora_spectrum", _KNOWN + "SELECT module, k::BIGINT AS place, round(s, 5) AS sigma FROM r WHERE k <= 8")
def lora_spectrum(spark, d: str) -> DataFrame:
    """The leading singular values of matrices whose spectrum is known."""
    return lowrank.low_rank_basis(_known(spark, d), rank=8).select("module", F.posexplode("sigma").alias("place", "sigma")).select("module", (F.col("place") + 1).cast("long").alias("place"), F.round("sigma", 5).alias("sigma"))


@query("lora_adapter", _KNOWN + "SELECT x.module, x.row_no, round(CASE WHEN k <= 8 THEN x ELSE 0 END, 4) + 0.0 AS entry FROM x JOIN r ON r.module = x.module AND r.j = x.j")
def lora_adapter(spark, d: str) -> DataFrame:
    """Of each row of the matrix its own entry in up @ down * alpha / rank: kept where the column is among the leading eight, else 0."""
    rows = lowrank.adapter(_known(spark, d), rank=8, alpha=2.0)[1]
    module = F.regexp_extract("key", r"^(m[^.]*)\.", 1)
    up = rows.filter(F.endswith("key", F.lit("up.weight"))).select(module.alias("module"), "row", F.col("values").alias("up"))
    down = rows.filter(F.endswith("key", F.lit("down.weight"))).select(module.alias("module"), F.posexplode("values").alias("j", "x"), "row").groupBy("module", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "x"))), lambda z: z.x).alias("down"))
    entry = F.aggregate(F.zip_with("up", "down", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x) * (2.0 / 8)
    return up.withColumn("j", (F.col("row") % 64).cast("int")).join(down, ["module", "j"]).select("module", F.col("row").alias("row_no"), (F.round(entry, 4) + 0.0).alias("entry"))


@query("lora_eligible", """WITH l AS (SELECT unnest(['blocks.' || p_partkey || '.attn.q', 'blocks.' || p_partkey || '.proj_out', 'final_layer.' || p_partkey, 'blocks.' || p_partkey || '.mlp.gate_logits', 'x.' || p_partkey || '.rope.w', 'blocks.' || p_partkey || '.scale']) AS base, p_size, p_partkey FROM part)
SELECT 'lora_unet_' || replace(base, '.', '_') AS module FROM l WHERE p_size % 9 <> 0 AND p_partkey % 5 <> 1 AND p_partkey % 4 <> 2 AND base NOT LIKE '%scale' AND base LIKE 'blocks%'""")
def lora_eligible(spark, d: str) -> DataFrame:
    """Weights that an adapter is extracted of: on both sides, two-dimensional, of one shape, named so."""
    layers = _layers(spark, d, tensors.tasks(6 * table(spark, d, "part").count())).withColumn("id", F.regexp_extract("base", r"\.(\d+)", 1).cast("long"))
    side = lambda df, prefix: df.select(F.concat(F.lit(prefix), "base", F.lit(".weight")).alias("key"), F.when(F.col("id") % 4 == 2, "I8").otherwise("F16").alias("dtype"), "shape")
    tuned = layers.withColumn("shape", F.when(F.col("id") % 5 == 1, F.transform("shape", lambda x: x + 1)).otherwise(F.col("shape")))
    return tensors.lora_pairs(side(layers, "net."), side(tuned, "diffusion_model."), include="^blocks", exclude=r"scale\.weight$").select("module")
