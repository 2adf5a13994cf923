"""Counts, coverage, status lines and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions.text import keep_first
from loomset.storage import Scratch


def common_tags(records: DataFrame, key: str = "sidecar_key", least: int = 2) -> DataFrame:
    """(tag, n): automatic and external tags of at least `least` records, once each, shown as first seen in order of key."""
    tags = F.concat(F.transform("auto_tags", lambda x: x.tag), F.transform("booru_tags", lambda x: x.tag))
    named = F.transform(F.filter(tags, lambda t: t != ""), lambda t: F.struct(F.lower(t).alias("low"), t.alias("tag")))
    # a record's repeats go within its row, so that only the count is shuffled
    held = records.select(key, named.alias("_t"))
    first = held.select(key, F.explode(keep_first(F.col("_t"), "low")).alias("t")).select(key, "t.low", "t.tag")
    counted = first.groupBy("low").agg(F.min_by("tag", key).alias("tag"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.select("tag", "n").orderBy(F.desc("n"), "tag")


def coverage(records: DataFrame, field: str, key: str = "sidecar_key") -> DataFrame:
    """(value, n, share of records) of an array field, occurrences counted, in order of first appearance."""
    total = records.count()
    each = records.select(key, F.posexplode(field).alias("ord", "value"))
    counted = each.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct(key, "ord")).alias("at"))
    return counted.select("value", "n", (F.col("n") / F.lit(max(total, 1))).alias("share"), "at").orderBy("at").drop("at")


def caption_models(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.map_keys("captions")).alias("model")).groupBy("model").agg(F.count("*").alias("n")).orderBy("model")


def flags(tagger: Column, captions: Column, booru: Column, manual: Column, path: Column) -> Column:
    """A status line: [TCB] manual=N path. Images without a record have blanks and 0."""
    mark = lambda c, x: F.when(c, x).otherwise(" ")
    return F.format_string("[%s%s%s] manual=%d %s", mark(tagger.isNotNull(), "T"), mark(F.coalesce(F.cardinality(captions), F.lit(0)) > 0, "C"), mark(booru.isNotNull(), "B"), F.coalesce(F.size(manual), F.lit(0)), path)


def nearest_rank(totals: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the values at rank round((n - 1) * p), in 32-bit floats and half away from zero, the largest, and the count. Null values don't count.

    A selection over sorted ranges: values are counted once, their counts lie in sorted ranges, the ranges' sums (a row each) tell which range holds
    a rank, and only those ranges are ordered, each in a task of its own. So neither the number of rows nor that of distinct values meets in one task.
    """
    with Scratch(totals.sparkSession) as run:
        counts = totals.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
        ranged = run.settle(run.settle(counts, "counts").repartitionByRange("v").withColumn("range", F.spark_partition_id()), "ranges")
        sums = ranged.groupBy("range").agg(F.sum("c").alias("c"), F.max("v").alias("most"))
        whole = W.orderBy("range")  # over the ranges' sums alone
        placed = run.settle(sums.withColumn("before", F.sum("c").over(whole) - F.col("c")), "sums")
        total = placed.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max("most").alias("max")).first()
        n = F.lit(total["n"])
        at = lambda p: F.round(((n - 1).cast("float") * F.lit(p).cast("float")).cast("float")).cast("long")
        ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(p).alias("rank")) for name, p in shares.items()]))
        wanted = placed.select("range", "before", "c", ranks.alias("r")).filter("before <= r.rank AND r.rank < before + c").select("range", "r.name", (F.col("r.rank") - F.col("before")).alias("rank"))
        inside = ranged.join(F.broadcast(wanted.select("range").distinct()), "range").withColumn("upto", F.sum("c").over(W.partitionBy("range").orderBy("v")))
        found = {r["name"]: r["v"] for r in inside.join(F.broadcast(wanted), "range").filter("upto > rank").groupBy("name").agg(F.min("v").alias("v")).collect()}
    kind = totals.schema[value].dataType.simpleString()
    return totals.sparkSession.createDataFrame([(*[found.get(name) for name in shares], total["max"], total["n"])], ", ".join([f"`{name}` {kind}" for name in shares] + [f"max {kind}", "n long"]))


def over_budget(counted: DataFrame, total: str, limit: int = 512) -> DataFrame:
    return counted.filter(F.col(total) > limit)


def run_counts(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """How many images a run tagged, skipped, moved and so on."""
    return outcomes.groupBy(outcome).agg(F.count("*").alias("n"))


def ranked_tags(scores: Column) -> Column:
    """Tagger output: by score, falling, ties in dictionary order. scores: array of structs with score and idx."""
    return F.array_sort(scores, lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.idx < b.idx, -1).when(a.idx > b.idx, 1).otherwise(0))


def first_max(values: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")
