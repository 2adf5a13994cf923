"""Sharding by proportional stratified interleaving: every shard, and every stretch of a shard, has the mixture of the whole.

Rows of each source are ranked in a seeded random order; rank r of a source's n rows has the fractional rank (r - 1/2) / n. Rows sorted by it
interleave the sources in proportion, and equal cuts of that order are the shards, whose numbers of rows differ by one at most (law `rows`).

Ranks need no sampling and no task that holds a source. Random keys are uniform, so the first hex digits of the key cut every source, a hot one
too, into even ranges; fractional ranks are uniform, so equal steps of them cut the whole into even buckets. A range or bucket has about ROWS rows
at most, and is ranked in one task; only the numbers of rows of ranges and buckets are summed up before that. Texts aren't shuffled.

Defined cases: a null text has no bytes, so size 1 and CRC 0; null sources are one source, ordered first; a null doc_id has a key from its text
alone; rows that agree in doc_id, CRC and size are told apart by nothing, and any order of them gives the same rows; repeated rows have a place
each; an empty table gives no rows; further columns are ignored by
`place`, and kept by `write` but for those named shard and slot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.llm.common import settle

#: Rows of a range or bucket that one task sorts, about.
ROWS = 1_000_000
#: Buckets of fractional ranks at least, so that small tables are spread too.
BUCKETS = 64


def _before(sizes: DataFrame, key: str, *within: str) -> DataFrame:
    """sizes (key, n) with `before`: the sum of n over the earlier keys of the same `within`. A row for each range, not for each row of the table."""
    ahead = W.partitionBy(*within).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")))


#: What a row's place follows from: rows alike in these are interchangeable.
ROW = ["doc_id", "stratum", "text_crc32", "size"]


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    stratum = F.concat(F.when(F.col("source").isNull(), "-").otherwise("="), F.coalesce("source", F.lit("")))
    return docs.withColumns({"stratum": stratum, "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)})


def place(docs: DataFrame, shards: int = 8, seed: str = "shard") -> DataFrame:
    """(doc_id, source, stratum, size, text_crc32, shard, slot) of every row; stratum is source without nulls."""
    narrow = _narrow(docs.select("doc_id", "source", "text")).drop("text")
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    keyed = settle(narrow.withColumn("key", F.md5(named.cast("binary"))), "keyed")

    strata = settle(keyed.groupBy("stratum").agg(F.count("*").alias("of")), "strata")
    most, total = strata.agg(F.coalesce(F.max("of"), F.lit(0)), F.coalesce(F.sum("of"), F.lit(0))).first()
    digits = max(2, math.ceil(math.log(max(1, most / ROWS), 16)))
    ranged = keyed.withColumn("range", F.substring("key", 1, digits))
    sizes = _before(ranged.groupBy("stratum", "range").agg(F.count("*").alias("n")), "range", "stratum").join(strata, "stratum")
    inside = W.partitionBy("stratum", "range").orderBy("key", "doc_id", "text_crc32", "size")
    ranks = ranged.withColumn("_at", F.row_number().over(inside)).join(sizes.select("stratum", "range", "before", "of"), ["stratum", "range"])
    fraction = (F.col("before") + F.col("_at") - F.lit(0.5)) / F.col("of")
    buckets = max(BUCKETS, math.ceil(total / ROWS))
    ranked = settle(ranks.withColumn("fraction", fraction).withColumn("bucket", F.floor(F.col("fraction") * buckets)).drop("before", "_at", "of", "range"), "ranked")

    offsets = _before(ranked.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    order = W.partitionBy("bucket").orderBy("fraction", "stratum", "key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_at", F.row_number().over(order)).join(offsets.select("bucket", "before"), "bucket").withColumn("_at", F.col("before") + F.col("_at") - 1)
    # shard s begins at the first place p with p * shards >= s * total
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    numbered = placed.withColumn("shard", F.expr(f"_at * {shards} div {max(1, total)}"))
    return numbered.select("doc_id", "source", "stratum", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_at") - start).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, seed: str = "shard") -> None:
    """Files by shard (path/shard=0, ..), in order of slot inside and across a shard's files, with slot and all columns of docs but those named shard and slot.

    Whole rows are shuffled twice: to their places, and by ranges of slots. A row finds its place by what the place follows from, and by its number
    among rows alike in that.
    """
    nth = F.row_number().over(W.partitionBy(*ROW).orderBy(F.lit(0)))
    whole = _narrow(docs.select("doc_id", "source", "text", F.struct(*[c for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("row"))).select(*ROW, "row").withColumn("nth", nth).alias("a")
    to = settle(place(docs, shards, seed).select(*ROW, "shard", "slot").withColumn("nth", nth), "places").alias("b")
    rows = whole.join(to, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*ROW, "nth"]]).select("row.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    """A shard and slot for every document, by the law `rows`."""
    placed = place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP12_SQL = r"""
WITH bits AS (
  SELECT i, (WITH RECURSIVE r(k, v) AS (SELECT 0, i::BIGINT UNION ALL SELECT k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM r WHERE k < 8) SELECT v FROM r WHERE k = 8) AS v FROM range(256) t(i)
), tab AS (SELECT list(v ORDER BY i) AS tab FROM bits),
d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS stratum, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, y: xor(a // 256, tab.tab[(xor(a % 256, y) + 1)::INT]), 4294967295), 4294967295) AS text_crc32 FROM documents, tab
), k AS (SELECT *, md5('shard:' || coalesce(doc_id::VARCHAR, 'none') || ':' || text_crc32 || ':' || size) AS key FROM d),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - 0.5::DOUBLE) / (count(*) OVER (PARTITION BY stratum))::DOUBLE AS fraction FROM k
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM f
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // total)::INT AS shard, (place - ((place * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""
