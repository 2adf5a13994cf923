"""Records derived by rule from the driver's tables, which hold no tags of their own; with the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.storage import importable

CATEGORY = "CASE event_type WHEN 'error' THEN 'meta' WHEN 'purchase' THEN 'character' WHEN 'click' THEN 'artist' ELSE 'general' END"
#: (order, divisor of the id, manual tag)
MANUAL = [(1, 3, "-error"), (2, 4, "Purchase"), (3, 5, "_reviewed"), (4, 7, " view ")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _manual(key: Column) -> Column:
    return F.filter(F.array(*[F.when(key % m == 0, F.lit(t)) for _, m, t in MANUAL]), lambda t: t.isNotNull())


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each user of events. One shuffle by user: the tags of a user are counted within its group."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"), F.count("*").alias("n"))
    tag = F.struct((-(F.col("v") / F.lit(400.0)).cast("float")).alias("neg"), F.col("event_type").alias("tag"), F.expr(CATEGORY).alias("category"), "n")
    grouped = e.groupBy("user_id").agg(F.sort_array(F.collect_list(tag)).alias("t"))
    auto = F.transform("t", lambda x: F.struct(x.tag.alias("tag"), (-x.neg).alias("score"), x.category.alias("category")))
    booru = F.array_sort(F.transform(F.filter("t", lambda x: x.n >= 2), lambda x: F.struct(x.tag.alias("tag"), x.category.alias("category"))))
    return grouped.select(
        "user_id", F.col("user_id").cast("string").alias("sidecar_key"), _manual(F.col("user_id")).alias("manual_tags"), auto.alias("auto_tags"), booru.alias("booru_tags"),
        F.expr("cast(map() as map<string,struct<caption:string,captioned_at:timestamp,skip:boolean>>)").alias("captions"), F.lit(None).cast("string").alias("manual_caption"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit(" left is a "), F.lit(""), F.lit("right is b"))).otherwise(F.array().cast("array<string>")).alias("caption_hints"),
        F.when(F.col("user_id") % 6 != 0, F.struct(F.lit("wd").alias("model"), F.lit(None).cast("timestamp").alias("tagged_at"))).alias("tagger"),
        F.when(F.col("user_id") % 4 != 1, F.struct(F.lit("danbooru").alias("source"), F.col("user_id").alias("post_id"), F.lit(None).cast("string").alias("post_url"), F.lit(None).cast("timestamp").alias("fetched_at"))).alias("booru"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each conversation: a caption for each turn, every third skipped, and the system text as the manual caption."""
    c = table(spark, sf_dir, "conversations")
    entry = F.struct(F.concat_ws(".", "role", "turn").alias("key"), F.struct(F.col("text").alias("caption"), F.lit(None).cast("timestamp").alias("captioned_at"), (F.col("turn") % 3 == 2).alias("skip")).alias("value"))
    return c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("captions"), F.max(F.when((F.col("role") == "system") & (F.col("conv_id") % 2 == 0), F.col("text"))).alias("manual_caption")).select(
        "conv_id", F.col("conv_id").cast("string").alias("sidecar_key"), "captions", "manual_caption",
        F.filter(F.array(F.when(F.col("conv_id") % 3 == 0, F.lit("_Realistic")), F.when(F.col("conv_id") % 5 == 0, F.lit("Night"))), lambda t: t.isNotNull()).alias("manual_tags"),
    )


SQL = f"""
a AS (
  SELECT user_id, event_type AS tag, (max(value) / 400.0::DOUBLE)::FLOAT AS score, count(*) AS n, {CATEGORY} AS category FROM events GROUP BY user_id, event_type
), u AS (
  SELECT DISTINCT user_id FROM events
), auto AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, tag) AS ord FROM a
), booru AS (
  SELECT user_id, tag, category, row_number() OVER (PARTITION BY user_id ORDER BY tag) AS ord FROM a WHERE n >= 2
), manual AS (
  SELECT user_id, ord, tag FROM u, (VALUES {", ".join(f"({o}, {m}, '{t}')" for o, m, t in MANUAL)}) AS r(ord, m, tag) WHERE user_id % m = 0
), lists AS (
  SELECT user_id, coalesce((SELECT list(tag ORDER BY ord) FROM manual WHERE manual.user_id = u.user_id), []) AS manual_tags FROM u
), supp AS (
  SELECT DISTINCT user_id, lower(trim(substr(trim(tag), 2))) AS tag FROM manual WHERE trim(tag) LIKE '-%'
), pos AS (
  SELECT * FROM manual WHERE trim(tag) NOT LIKE '-%'
), eff AS (
  (SELECT user_id, lower(trim(tag)) AS tag FROM pos UNION SELECT user_id, lower(tag) FROM a UNION SELECT user_id, lower(tag) FROM booru) EXCEPT SELECT user_id, tag FROM supp
)"""


def exported(threshold: float = 0.35, exclude: str = "", prefix: str = "@", columns: str = "user_id") -> str:
    """CTE `first` of exported tags in long form, of records as above."""
    skip = f"AND category NOT IN ('{exclude}')" if exclude else ""
    show = f"CASE WHEN category = 'artist' THEN '{prefix}' || tag ELSE tag END"
    bare = (lambda x: f"lower(CASE WHEN starts_with({x}, '{prefix}') THEN substr({x}, {len(prefix) + 1}) ELSE {x} END)") if prefix else (lambda x: f"lower({x})")
    return f"""
cand AS (
  SELECT user_id, 0 AS src, ord, trim(tag) AS shown, {bare("trim(tag)")} AS stem FROM pos WHERE trim(tag) <> '' AND trim(tag) NOT LIKE '\\_%' ESCAPE '\\'
  UNION ALL SELECT user_id, 1, ord, {show}, {bare(show)} FROM auto WHERE score >= {threshold}::FLOAT {skip} AND (user_id, lower(tag)) NOT IN (SELECT user_id, tag FROM supp)
  UNION ALL SELECT user_id, 2, ord, {show}, {bare(show)} FROM booru WHERE true {skip} AND (user_id, lower(tag)) NOT IN (SELECT user_id, tag FROM supp)
), first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, stem ORDER BY src, ord) AS n FROM cand) WHERE n = 1
)"""


_FLAT = r"regexp_replace(regexp_replace({0}, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g'), '[\p{{Z}}\s]+', ' ', 'g')"
CAPTIONS_SQL = f"""
cap AS (
  SELECT conv_id, role || '.' || turn AS key, {_FLAT.format("text")} AS line, turn % 3 = 2 AS skip FROM conversations
), man AS (
  SELECT conv_id, max(CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN text END) AS manual FROM conversations GROUP BY conv_id
), caption AS (
  SELECT conv_id, coalesce(nullif(regexp_replace(manual, '^[\\p{{Z}}\\s]+|[\\p{{Z}}\\s]+$', '', 'g'), ''),
    (SELECT string_agg(line, chr(10) ORDER BY key) FROM cap WHERE cap.conv_id = man.conv_id AND NOT skip AND line <> '')) AS caption FROM man
)"""
