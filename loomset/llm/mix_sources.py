"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of sizes, and a cut at each source's exact budget.

Defined cases: a null text has size 0; null sources are one source, ordered last; rows that repeat a doc_id have one order by (key, doc_id,
size, text), so reruns agree; rows with null ids have keys from their texts; an empty table gives no rows; sources of size 0 get target 0; columns with
the names of results give way. Keys are uniform, so equal ranges of the key space hold
equal shares of a source's rows: `digits` hex digits cut every source, a hot one too, into 16 ** digits sorted ranges, and more digits are taken
where a range would hold more than ROWS rows; results don't depend on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a range that one task sorts, about.
ROWS = 1_000_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """docs (doc_id, source, tie, ..) with a hash-random _key, in hex digits."""
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.col("tie").cast("string"))))
    return docs.withColumn("_key", F.md5(named.cast("binary")))


def _slot(digits: int) -> Column:
    return F.concat(F.substring("_key", 1, digits), F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))


def running(rows: DataFrame, order: list[str | Column], **values: Column) -> DataFrame:
    """rows with, for each name, the sum of the value over the rows up to and with each, in an order without ties.

    Rows are cut into sorted ranges; a range's rows are summed up in one task, and only the ranges' totals, one row each, are ordered together.
    """
    cut = settle(rows.repartitionByRange(*order).withColumns(values).withColumn("_range", F.spark_partition_id()), "cut")
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select("_range", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"_{v}") for v in values])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = cut.withColumns({v: F.sum(v).over(inside) for v in values}).join(F.broadcast(offsets), "_range")
    return summed.select(*rows.columns, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with weight and target: share * all sizes dealt by weight, none above most * its size, the excess dealt again.

    Dealing again until none is above ends at one level per unit of weight, found here by prefix sums over sources in the order in which they
    fill up. One row per source; the driver gets the totals and the level.
    """
    ranked = running(sources, [F.col("source").isNull(), "source"], rank=F.lit(1))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    caps = settle(ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")), "caps")
    all_ = caps.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weight = float(share) * (all_["size"] or 0), all_["weight"] or 0.0
    filling = running(caps, ["ratio", "rank"], caps=F.col("cap"), filled=F.col("weight"))
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))) / (F.lit(weight) - (F.col("filled") - F.col("weight")))
    first = filling.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("ratio", "rank", "level"))["level"].alias("level")).first()["level"]
    return caps.select("source", "source_size", "weight", F.col("cap").alias("target") if first is None else F.least("cap", F.lit(first) * F.col("weight")).alias("target"))


ADDED = ("size", "source_size", "target", "taken", "epoch")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", digits: int = 2, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, taken (words the mix takes, repeats counted), in place of columns of those names. size, tie: expressions for the size and for what tells rows of one id apart, if not the words and a hash of text.

    One aggregation over (source, key range), a small table, gives all totals; a range's prefix is the sum of those before it; inside a range a sorted window
    runs. Documents are shuffled once, by (source, range).
    """
    sized = words_in(F.col("text")) if size is None else size
    apart = F.xxhash64("text") if tie is None else tie
    rest_of = [c for c in docs.columns if c.lower() not in ADDED]
    keyed = _keyed(docs.select("doc_id", "source", sized.alias("size"), apart.alias("tie"), F.struct(*rest_of).alias("row")), seed)
    before_it = None  # where more digits don't help, rows share a key
    while True:
        slotted = keyed.withColumn("_slot", _slot(digits))
        ranges = settle(slotted.groupBy("_slot", "source").agg(F.sum("size").alias("range_size"), F.count("*").alias("rows")), "ranges")
        largest = ranges.agg(F.max("rows")).first()[0] or 0
        if largest <= ROWS or largest == before_it or digits >= 8:
            break
        before_it = largest
        digits = min(8, digits + max(1, math.ceil(math.log(largest / ROWS, 16))))
    keyed = slotted
    dealt = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    info = ranges.withColumn("_before", before).join(dealt.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("_slot", "_before", "source_size", "target")
    inside = F.sum("size").over(W.partitionBy("_slot").orderBy("_key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = keyed.join(info, "_slot").withColumn("_at", F.col("_before") + inside)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at")))
    return placed.select("row.*", "size", "source_size", "target", taken.cast("long").alias("taken"))


def materialise(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with `epoch` from 0; the document at a source's cut has the words up to it."""
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    rows = mixed.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), (copies - 1).cast("long"))))
    left = (F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))).cast("int")
    return rows.withColumn("text", F.when(left < F.col("size"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), left), " ")).otherwise(F.col("text")))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("n"), F.xxhash64("text").alias("t"))
    return mix(sized, size=F.col("n"), tie=F.col("t")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, (SELECT min_by(level, ratio) FROM (SELECT level, ratio FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1)) * weight) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS place,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - place)))::BIGINT AS taken FROM p
"""
