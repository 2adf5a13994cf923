"""The tag dictionary: CSV of tag_id, name, category and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.schema import CATEGORIES


def category_name(number: Column) -> Column:
    out = F.concat(F.lit("category_"), number.cast("string"))
    for k, v in CATEGORIES.items():
        out = F.when(number == k, v).otherwise(out)
    return out


def load(spark: SparkSession, path: str) -> DataFrame:
    """(tag_id, name, category number, count, category_name). Malformed lines fail."""
    raw = spark.read.schema("tag_id long, name string, category int, count long").csv(path, header=True, mode="FAILFAST")
    return raw.withColumn("category_name", category_name(F.col("category")))


def tagged(dictionary: DataFrame, scores: DataFrame, threshold: float = 0.10) -> DataFrame:
    """(sidecar_key, auto_tags) from scores (sidecar_key, scores by place in the dictionary): those that reach the threshold, by score, ties in dictionary order."""
    each = scores.select("sidecar_key", F.posexplode("scores").alias("idx", "score")).filter(F.col("score") >= F.lit(threshold).cast("float"))
    named = each.join(dictionary.select("idx", "name", "category_name"), "idx")
    entry = F.struct((-F.col("score")).alias("neg"), "idx", F.col("name").alias("tag"), F.col("category_name").alias("category"))
    listed = named.groupBy("sidecar_key").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    return listed.select("sidecar_key", F.transform("t", lambda x: F.struct(x.tag.alias("tag"), (-x.neg).alias("score"), x.category.alias("category"))).alias("auto_tags"))
