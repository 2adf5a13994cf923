"""Queries over tensors derived from embeddings, and over layer names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators import enrich, lowrank, tensors
from loomset.functions import paths
from loomset.plans.derive import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _tensor(df: DataFrame, key: str, values: F.Column) -> DataFrame:
    return df.select(F.concat(F.lit(key), F.col("vec_id").cast("string")).alias("key"), F.when(F.col("vec_id") % 11 == 0, "I8").otherwise("F32").alias("dtype"), F.array(F.lit(64).cast("long")).alias("shape"), values.alias("values"))


def _three(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base: the embeddings; tuned: each times 1.01, some missing; target: under another name space, some of another shape."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    base = _tensor(e, "net.w", F.col("v"))
    tuned = _tensor(e.filter("vec_id % 7 <> 0"), "model.diffusion_model.w", F.transform("v", lambda x: (x * F.lit(1.01).cast("float")).cast("float")))
    target = _tensor(e.filter("vec_id % 13 <> 0"), "diffusion_model.w", F.transform("v", lambda x: (x + F.lit(1.0).cast("float")).cast("float"))).withColumn("shape", F.when(F.endswith("key", F.lit("5")), F.array(F.lit(8).cast("long"), F.lit(8).cast("long"))).otherwise(F.col("shape")))
    return base, tuned, target


_THREE = """WITH e AS (SELECT vec_id, embedding::FLOAT[] AS v FROM embeddings), t AS (
  SELECT vec_id, 'diffusion_model.w' || vec_id AS key, v, list_transform(v, lambda x: (x + 1.0::FLOAT)::FLOAT) AS target, list_transform(v, lambda x: ((x * 1.01::FLOAT)::FLOAT - x)::FLOAT) AS delta,
    vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id::VARCHAR NOT LIKE '%5' AS applied FROM e WHERE vec_id % 13 <> 0
), m AS (
  SELECT *, CASE WHEN applied THEN list_transform(list_zip(target, delta), lambda z: (z[1] + (0.5::FLOAT * z[2])::FLOAT)::FLOAT) ELSE target END AS merged, CASE WHEN applied THEN list_max(list_transform(delta, lambda x: abs(x))) END AS max_delta FROM t
)
"""


@query("merge_diff", _THREE + "SELECT key, applied, round(list_sum(list_transform(merged, lambda x: x::DOUBLE)), 6) AS total, list_max(merged) AS largest, max_delta FROM m")
def merge_diff(spark, d: str) -> DataFrame:
    out = tensors.merge_diff(*_three(spark, d), multiplier=0.5)
    return out.select("key", "applied", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"), F.array_max("values").alias("largest"), "max_delta")


@query("merge_stats", _THREE + "SELECT max(max_delta) AS max_delta, round(sum(CASE WHEN applied THEN list_sum(list_transform(delta, lambda x: abs(x)::DOUBLE)) / 64 END), 6) AS sum_mean_delta, count(*) FILTER (applied)::BIGINT AS applied, count(*) FILTER (NOT applied)::BIGINT AS carried, max(max_delta) < 0.0001::FLOAT AS negligible FROM m")
def merge_stats(spark, d: str) -> DataFrame:
    return tensors.merge_stats(tensors.merge_diff(*_three(spark, d), multiplier=0.5)).withColumn("sum_mean_delta", F.round("sum_mean_delta", 6))


@query("merge_gaps", "SELECT 'w' || vec_id AS bare, 'base only' AS gap FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT 'w' || vec_id, 'not delivered' FROM embeddings WHERE vec_id % 7 <> 0 AND (vec_id % 13 = 0 OR vec_id % 11 = 0 OR vec_id::VARCHAR LIKE '%5')")
def merge_gaps(spark, d: str) -> DataFrame:
    return tensors.merge_gaps(*_three(spark, d))


def _rows(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<float>").alias("values"))


@query("hadamard_rotate", """WITH h AS (SELECT i, j, CASE WHEN (SELECT count(*) FROM range(0, 3) AS d(k) WHERE ((i >> (2 * k)) & 3) + ((j >> (2 * k)) & 3) = 3) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM range(0, 64) AS a(i), range(0, 64) AS b(j))
SELECT vec_id, h.i::INTEGER AS place, round(sum(v.x::DOUBLE * h.s) * 0.125, 6) AS value FROM (SELECT vec_id, unnest(embedding::FLOAT[]) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) v JOIN h ON h.j = v.j GROUP BY vec_id, h.i""")  # fmt: skip
def hadamard_rotate(spark, d: str) -> DataFrame:
    """All vectors, each of the 64 values checked one by one."""
    return _rows(spark, d).select("vec_id", F.posexplode(tensors.rotate(F.col("values"), 64)).alias("place", "value")).withColumn("value", F.round("value", 6))


@query("hadamard_twice", "SELECT vec_id, true AS same FROM embeddings")
def hadamard_twice(spark, d: str) -> DataFrame:
    """Rotating twice gives the vector back: all rows."""
    once = _rows(spark, d).withColumn("r", tensors.rotate(F.col("values"), 64))
    return once.select("vec_id", F.forall(F.arrays_zip(F.col("values"), tensors.rotate(F.col("r"), 64).alias("back")), lambda z: F.abs(z["values"] - z["back"]) < 1e-5).alias("same"))


_Q = """WITH s AS (SELECT vec_id, label, embedding::FLOAT[] AS v, greatest((greatest(list_max(list_transform(embedding::FLOAT[], lambda x: abs(x))), 1e-30::FLOAT) / 127.0::FLOAT)::FLOAT, 1e-30::FLOAT) AS scale FROM embeddings),
q AS (SELECT *, list_transform(v, lambda x: greatest(least(round_even((x / scale)::FLOAT, 0), 127), -127)::TINYINT) AS codes FROM s),
z AS (SELECT vec_id, label, unnest(v)::DOUBLE AS x, (unnest(codes)::FLOAT * scale)::FLOAT::DOUBLE AS y FROM q),
e AS (SELECT label, 100 * sqrt(sum((x - y) * (x - y))) / sqrt(sum(x * x)) AS relerr, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine FROM z GROUP BY label)
"""


@query("quant_absmax", _Q + "SELECT vec_id, scale, array_to_string(codes, ',') AS codes FROM q")
def quant_absmax(spark, d: str) -> DataFrame:
    return tensors.quantise(_rows(spark, d)).select("vec_id", "scale", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


def _errors(spark, d: str) -> DataFrame:
    return tensors.layer_errors(tensors.quantise(_rows(spark, d)), ["label"])


@query("quant_error", _Q + "SELECT label, round(relerr, 6) AS relerr, round(cosine, 6) AS cosine FROM e")
def quant_error(spark, d: str) -> DataFrame:
    return tensors.refuse_bad(_errors(spark, d)).select("label", F.round("relerr", 6).alias("relerr"), F.round("cosine", 6).alias("cosine"))


@query("quant_error_report", _Q + "SELECT round(avg(relerr), 6) AS mean, round(min(relerr), 6) AS min, round(max(relerr), 6) AS max, count(*) FILTER (relerr > 0.6)::BIGINT AS n_over, count(*)::BIGINT AS n FROM e")
def quant_error_report(spark, d: str) -> DataFrame:
    r = tensors.error_report(_errors(spark, d), 0.6)
    return r.select(*[F.round(c, 6).alias(c) for c in ("mean", "min", "max")], "n_over", "n")


@query("worst_layers", _Q + "SELECT label, round(relerr, 6) AS relerr FROM e ORDER BY e.relerr DESC, label LIMIT 3")
def worst_layers(spark, d: str) -> DataFrame:
    return tensors.worst(_errors(spark, d), 3).select("label", F.round("relerr", 6).alias("relerr"))


_H = """WITH h AS (SELECT i, j, CASE WHEN (SELECT count(*) FROM range(0, 3) AS d(k) WHERE ((i >> (2 * k)) & 3) + ((j >> (2 * k)) & 3) = 3) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM range(0, 64) AS a(i), range(0, 64) AS b(j)),
t AS (SELECT vec_id, label, list(x ORDER BY i) AS v FROM (SELECT vec_id, label, h.i, (sum(v.x::DOUBLE * h.s) * 0.125)::FLOAT AS x FROM (SELECT vec_id, label, unnest(embedding::FLOAT[]) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) v JOIN h ON h.j = v.j GROUP BY vec_id, label, h.i) GROUP BY vec_id, label),
s AS (SELECT vec_id, 'blocks.' || label || '.w' AS base, v, greatest((greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-30::FLOAT) / 127.0::FLOAT)::FLOAT, 1e-30::FLOAT) AS scale FROM t),
q AS (SELECT vec_id, base, scale, list_transform(v, lambda x: greatest(least(round_even((x / scale)::FLOAT, 0), 127), -127)::INTEGER) AS codes FROM s)
"""


def _int8(spark, d: str) -> DataFrame:
    """Each label's vectors are the rows of a layer."""
    rows = _rows(spark, d).select(F.concat(F.lit("blocks."), F.col("label").cast("string"), F.lit(".w")).alias("base"), F.col("vec_id").alias("row"), "values")
    layers = rows.groupBy("base").agg(F.array(F.count("*"), F.first(F.size("values").cast("long"))).alias("shape"))
    return tensors.int8(rows, tensors.layer_plan(layers, min_gemm=0))


@query("quant_int8", _H + """SELECT base || '.weight' AS key, 'I8' AS dtype, vec_id AS row_no, array_to_string(codes, ',') AS content FROM q
UNION ALL SELECT base || '.comfy_quant', 'U8', NULL, array_to_string(list_transform(string_split('{"format": "int8_tensorwise", "convrot": true, "convrot_groupsize": 64}', ''), lambda c: ascii(c)), ',') FROM (SELECT DISTINCT base FROM q)""")
def quant_int8(spark, d: str) -> DataFrame:
    """Codes and settings of all layers, after rotation; scales have a query of their own, as numbers."""
    return tensors.int8_tensors(_int8(spark, d)).filter("dtype <> 'F32'").select("key", "dtype", F.col("row").alias("row_no"), F.array_join(F.transform("values", lambda x: x.cast("int").cast("string")), ",").alias("content"))


@query("quant_int8_scales", _H + "SELECT base || '.weight_scale' AS key, vec_id AS row_no, round(scale::DOUBLE, 9) AS scale FROM q")
def quant_int8_scales(spark, d: str) -> DataFrame:
    return tensors.int8_tensors(_int8(spark, d)).filter("dtype = 'F32'").select("key", F.col("row").alias("row_no"), F.round(F.col("values")[0].cast("double"), 9).alias("scale"))


@query("quant_errors_by_gs", _Q.replace("WITH s AS (SELECT vec_id, label, embedding::FLOAT[] AS v,", "WITH s0 AS (SELECT vec_id, label, CASE WHEN hash_of % 2 = 1 THEN embedding[:16] ELSE embedding END AS embedding FROM (SELECT *, length(label::VARCHAR) + ascii(right(label::VARCHAR, 1)) AS hash_of FROM embeddings)), s AS (SELECT vec_id, label, embedding::FLOAT[] AS v,").replace("FROM embeddings),\nq AS", "FROM s0),\nq AS") + "SELECT CASE WHEN (length(label::VARCHAR) + ascii(right(label::VARCHAR, 1))) % 2 = 1 THEN 16 ELSE 64 END::INTEGER AS gs, round(avg(relerr), 6) AS mean, round(max(relerr), 6) AS max, count(*)::BIGINT AS n FROM e GROUP BY 1")
def quant_errors_by_gs(spark, d: str) -> DataFrame:
    """Some labels' layers are 16 wide, the others 64."""
    name = F.col("label").cast("string")
    gs = F.when((F.length(name) + F.ascii(F.right(name, F.lit(1)))) % 2 == 1, 16).otherwise(64)
    rows = _rows(spark, d).withColumn("gs", gs).withColumn("values", F.slice("values", 1, F.col("gs")))
    errors = tensors.layer_errors(tensors.quantise(rows), ["label", "gs"])
    return tensors.errors_by_gs(errors).select("gs", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"), "n")


_NAMES = "['blocks.{p}.attn.q', 'blocks.{p}.proj_out', 'final_layer.{p}', 'blocks.{p}.mlp.gate_logits', 'x.{p}.rope.w', 'blocks.{p}.scale']"


def _layers(spark, d: str, parts: int | None = None) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size")
    p = p.repartition(parts) if parts else p  # before each row becomes six
    names = F.array(*[F.concat(F.lit(a), F.col("p_partkey").cast("string"), F.lit(b)) for a, b in (x.split("{p}") for x in _NAMES.strip("[]").replace("'", "").split(", "))])
    shape = F.when(F.col("p_size") % 9 == 0, F.array(F.lit(64))).otherwise(F.array(F.col("p_size") * 16 - 12, F.when(F.col("p_size") % 2 == 0, 512).when(F.col("p_size") % 3 == 0, 48).otherwise(100)))
    return p.select(F.explode(names).alias("base"), shape.cast("array<bigint>").alias("shape"), F.when(F.col("p_partkey") % 3 == 0, "F32").when(F.col("p_partkey") % 3 == 1, "BF16").otherwise("F16").alias("dtype"))


def _plan_sql(deny: str) -> str:
    named = ", ".join("'" + a + "' || p_partkey || '" + b + "'" for a, b in (x.split("{p}") for x in _NAMES.strip("[]").replace("'", "").split(", ")))
    return f"""WITH l AS (
  SELECT unnest([{named}]) AS base, CASE WHEN p_size % 9 = 0 THEN [64] ELSE [p_size * 16 - 12, CASE WHEN p_size % 2 = 0 THEN 512 WHEN p_size % 3 = 0 THEN 48 ELSE 100 END] END AS shape, CASE p_partkey % 3 WHEN 0 THEN 'F32' WHEN 1 THEN 'BF16' ELSE 'F16' END AS dtype FROM part
), g AS (
  SELECT *, shape[1] AS n, shape[2] AS k, CASE WHEN shape[2] % 256 = 0 THEN 256 WHEN shape[2] % 64 = 0 THEN 64 WHEN shape[2] % 16 = 0 THEN 16 END AS best, string_split(base, '.') AS segs FROM l
), r AS (
  SELECT *, CASE WHEN len(shape) <> 2 THEN 'not-2d' WHEN n < 8 THEN 'small-N' WHEN best IS NULL THEN 'ineligible-K' WHEN len(list_filter(segs[:len(segs) - 1], lambda s: regexp_full_match(s, '[0-9]+'))) = 0 THEN 'not-in-indexed-block'
    WHEN len(list_filter(segs, lambda s: regexp_matches(s, '{deny}'))) > 0 THEN '{tensors.DENIED}' END AS r1 FROM g
), s AS (
  SELECT *, CASE WHEN regexp_matches(base, 'scale$') THEN 'excluded(flag)' ELSE r1 END AS r2 FROM r
), t AS (
  SELECT *, CASE WHEN regexp_matches(base, 'rope|1\\.scale') AND len(shape) = 2 AND n >= 8 AND best IS NOT NULL THEN NULL ELSE r2 END AS r3 FROM s
), plan AS (
  SELECT base, shape, dtype, CASE WHEN r3 IS NULL AND least(n, k) < 256 THEN 'below-min-gemm' ELSE r3 END AS reason, best FROM t
)
"""


def _plan(spark, d: str, mode: str = "effective") -> DataFrame:
    return tensors.layer_plan(_layers(spark, d), include=r"rope|1\.scale", exclude="scale$", deny_mode=mode)


for _mode in tensors.DENY:

    @query(f"quant_plan_{_mode}", _plan_sql(tensors.DENY[_mode]) + "SELECT base, reason, CASE WHEN reason IS NULL THEN best END::INTEGER AS gs FROM plan")
    def quant_plan(spark, d: str, mode: str = _mode) -> DataFrame:
        return _plan(spark, d, mode).select("base", "reason", "gs")


@query("quant_skip_reasons", _plan_sql(tensors.DENY["effective"]) + "SELECT reason, count(*)::BIGINT AS n FROM plan WHERE reason IS NOT NULL GROUP BY reason")
def quant_skip_reasons(spark, d: str) -> DataFrame:
    return tensors.skip_reasons(_plan(spark, d))


@query("quant_report", _plan_sql(tensors.DENY["effective"]) + "SELECT regexp_replace(base, '[0-9]+', 'N', 'g') AS pattern, best::INTEGER AS gs, count(*)::BIGINT AS n, min(array_to_string(shape, 'x')) AS shape, sum(shape[1] * shape[2])::BIGINT AS params FROM plan WHERE reason IS NULL GROUP BY 1, 2")
def quant_report(spark, d: str) -> DataFrame:
    return tensors.plan_report(_plan(spark, d))


@query("quant_gs_histogram", _plan_sql(tensors.DENY["effective"]) + "SELECT best::INTEGER AS gs, count(*)::BIGINT AS n FROM plan WHERE reason IS NULL GROUP BY 1")
def quant_gs_histogram(spark, d: str) -> DataFrame:
    return tensors.gs_histogram(_plan(spark, d))


@query("quant_downcasts", _plan_sql(tensors.DENY["effective"]) + f"SELECT base FROM plan WHERE reason IS NOT NULL AND dtype = 'F32' AND base NOT LIKE '%.scale' AND NOT regexp_matches(string_split(base, '.')[-1], '{tensors.DENY['effective']}')")
def quant_downcasts(spark, d: str) -> DataFrame:
    return tensors.downcasts(_plan(spark, d)).filter("downcast").select("base")


@query("compute_dtype", "SELECT CASE WHEN count(*) FILTER (p_partkey % 3 = 2) >= count(*) FILTER (p_partkey % 3 = 1) AND count(*) FILTER (p_partkey % 3 = 2) > 0 THEN 'F16' ELSE 'BF16' END AS dtype FROM part")
def compute_dtype(spark, d: str) -> DataFrame:
    return tensors.compute_dtype(_layers(spark, d).select(F.concat("base", F.lit(".weight")).alias("key"), "dtype"))


@query("quant_config", _plan_sql(tensors.DENY["effective"]) + """SELECT best::INTEGER AS gs, '{"format": "int8_tensorwise", "convrot": true, "convrot_groupsize": ' || best || '}' AS json, count(*)::BIGINT AS n FROM plan WHERE reason IS NULL GROUP BY best""")
def quant_config(spark, d: str) -> DataFrame:
    """The settings that the planned layers get, and how many get them."""
    return _plan(spark, d).filter("gs IS NOT NULL").withColumn("json", tensors.quant_json(F.col("gs"))).groupBy("gs", "json").agg(F.count("*").alias("n"))


@query("key_names", "SELECT p_partkey, 'lora_unet_b_' || p_partkey || '_w' AS lora, 'b.' || p_partkey || '.w.weight' AS bare, 'b.N.w.weight' AS pattern, '/m/a_' || p_partkey || '_int8_convrot-fp16.safetensors' AS dst, '/m/a_' || p_partkey || '_int8_convrot.safetensors' AS grown FROM part")
def key_names(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("model.diffusion_model.b."), F.col("p_partkey").cast("string"), F.lit(".w.weight")).alias("key"), F.concat(F.lit("/m/a_"), F.col("p_partkey").cast("string")).alias("file"))
    bare = paths.arch_stripped(F.col("key"))
    return p.select("p_partkey", paths.lora_name(bare).alias("lora"), bare.alias("bare"), paths.digits_collapsed(bare).alias("pattern"), paths.quantised_name(F.concat("file", F.lit("_BF16-fp16.safetensors"))).alias("dst"), paths.quantised_name(F.concat("file", F.lit(".ckpt"))).alias("grown"))


def _modules(spark, d: str) -> DataFrame:
    """A module for each label: its vectors as rows of a matrix, base against base * 1.01."""
    base = table(spark, d, "embeddings").select(paths.lora_name(F.format_string("blocks.%d.w.weight", "label")).alias("module"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<float>").alias("values"))
    tuned = base.withColumn("values", F.transform("values", lambda x: (x * F.lit(1.01).cast("float")).cast("float")))
    return tensors.delta_rows(base, tuned)


@query("lora_delta_norm", "SELECT 'lora_unet_blocks_' || label || '_w' AS module, count(*)::BIGINT AS rows, round(sum(list_sum(list_transform(embedding::FLOAT[], lambda x: (((x * 1.01::FLOAT)::FLOAT - x)::FLOAT)::DOUBLE ** 2))), 8) AS norm2 FROM embeddings GROUP BY label")
def lora_delta_norm(spark, d: str) -> DataFrame:
    return tensors.module_norms(_modules(spark, d)).select("module", "rows", F.round("norm2", 8).alias("norm2"))


@query("lora_energy")
def lora_energy(spark, d: str) -> DataFrame:
    found = lowrank.low_rank_basis(_modules(spark, d), rank=16).join(tensors.module_norms(_modules(spark, d)).select("module", "rows"), "module")
    return found.select("module", "rank", F.round("energy", 4).alias("energy"), (F.col("rows") * F.col("rank")).cast("int").alias("n_up"), F.size("basis").alias("n_down"))


@query("lora_full_rank", "SELECT count(DISTINCT label)::BIGINT AS n, true AS whole FROM embeddings")
def lora_full_rank(spark, d: str) -> DataFrame:
    """At full rank the factors hold all of the delta."""
    r = lowrank.energy_report(lowrank.low_rank_basis(_modules(spark, d), rank=64))
    return r.select("n", (F.abs(F.col("min") - 1) < 1e-9).alias("whole"))


@query("position_ids", """WITH p AS (SELECT p_partkey, p_size % 5 AS pad, 2 + p_size % 3 AS gh, 1 + p_size % 4 AS gw, p_size % 6 AS tail FROM part)
SELECT p_partkey, pad + greatest(gh, gw) + tail AS next, 3 * (pad + gh * gw + tail) AS n FROM p""")  # fmt: skip
def position_ids(spark, d: str) -> DataFrame:
    s = F.col("p_size")
    p = table(spark, d, "part").select("p_partkey", (s % 5).alias("pad"), (2 + s % 3).alias("gh"), (1 + s % 4).alias("gw"), (s % 6).alias("tail"))
    ids = paths.position_ids(F.col("pad") + F.col("gh") * F.col("gw") + F.col("tail"), F.col("pad"), F.col("gh") * F.col("gw"), F.col("gh") * 2, F.col("gw") * 2)
    return p.withColumn("i", ids).select("p_partkey", F.col("i.next").cast("int").alias("next"), (F.size("i.t") + F.size("i.h") + F.size("i.w")).alias("n"))


@query("combo_choices", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE 'a.pth|B.pth|c' || page_id || '.pth' END AS choices FROM pages")
def combo_choices(spark, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    listed = F.concat(F.lit('["c'), i, F.lit('.pth","B.pth",3,"a.pth"]'))
    spec = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("["), listed, F.lit(",{}]"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit('["COMBO",{"options":'), listed, F.lit("}]"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit('["COMBO",{"values":'), listed, F.lit("}]"))).otherwise(F.lit('["INT",{"min":1}]'))
    clean = F.regexp_replace(spec, ",3,", ",")
    return table(spark, d, "pages").select("page_id", F.array_join(enrich.combo_choices(clean), "|").alias("choices"))


@query("history_output", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'o' || page_id || '.png||output' WHEN 1 THEN 'x.png|s|output' ELSE 't.png||temp' END AS image FROM pages")
def history_output(spark, d: str) -> DataFrame:
    entry = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"outputs":{"1":{"images":[{"filename":"p.png","type":"output"}]},"9":{"images":[{"filename":"t.png","type":"temp"},{"filename":"o'), F.col("page_id").cast("string"), F.lit('.png"}]}}}'))).when(F.col("page_id") % 3 == 1, F.lit('{"outputs":{"1":{"text":["a"]},"2":{"images":[{"filename":"x.png","subfolder":"s","type":"output"}]}}}')).otherwise(F.lit('{"outputs":{"9":{"images":[{"filename":"t.png","type":"temp"}]}}}'))
    return table(spark, d, "pages").select("page_id", enrich.chosen_output(entry, "9").alias("o")).select("page_id", F.concat_ws("|", "o.filename", "o.subfolder", "o.kind").alias("image"))
