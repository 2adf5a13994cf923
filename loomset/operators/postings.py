"""Tag search by postings: trigrams of distinct tags, kept as tables in versions.

`tags` has each distinct folded tag with its number of holders, `grams` its trigrams, `holders` the records that have it. A search intersects the
postings of the needle's trigrams, confirms the few tags left by comparison, and fetches their holders; records aren't scanned. Needles under three
characters have no trigram and are compared with the distinct tags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.text import fold
from loomset.storage import Scratch, Versions


def _grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))


def held_tags(records: DataFrame, key: str) -> DataFrame:
    """(key, tag): distinct tags of all sources in lower case, manual ones with their signs."""
    every = F.array_union(F.array_union(F.transform("manual_tags", lambda t: F.lower(t)), F.transform("auto_tags", lambda x: F.lower(x.tag))), F.transform("booru_tags", lambda x: F.lower(x.tag)))
    return records.select(key, F.explode(every).alias("tag")).filter("tag IS NOT NULL")


class Postings:
    def __init__(self, spark: SparkSession, folder: str, key: str = "sidecar_key"):
        self.key, self.tables = key, Versions(spark, folder)

    def update(self, records: DataFrame, gone: DataFrame | None = None) -> None:
        """The postings with these records in place of their former versions, and without those of `gone` (key)."""
        held, grams = self.tables.read("holders"), self.tables.read("grams")
        with Scratch(records.sparkSession) as run:
            fresh = run.settle(held_tags(records, self.key), "fresh")
            now = fresh
            if held is not None:
                dropped = records.select(self.key).unionByName(gone.select(self.key)) if gone is not None else records.select(self.key)
                now = held.join(dropped.distinct(), self.key, "left_anti").unionByName(fresh)
            now = run.settle(now, "holders")
            tags = run.settle(now.groupBy("tag").agg(F.count("*").alias("n")), "tags")
            long = F.length("tag") >= 3
            if grams is None:
                made = tags.filter(long).select(F.explode(_grams(F.col("tag"))).alias("gram"), "tag")
            else:  # only tags not seen before are cut; those that nothing holds any more go
                new = tags.filter(long).join(grams.select("tag").distinct(), "tag", "left_anti")
                made = grams.join(tags, "tag", "left_semi").select("gram", "tag").unionByName(new.select(F.explode(_grams(F.col("tag"))).alias("gram"), "tag"))
            self.tables.write(holders=now.repartitionByRange("tag").sortWithinPartitions("tag"), tags=tags, grams=made.repartitionByRange("gram").sortWithinPartitions("gram", "tag"))

    def matching(self, needle: str) -> DataFrame:
        """(tag) of the distinct tags that contain the needle, in any case."""
        text = self.tables.spark.range(1).select(fold(F.lit(needle)).alias("x")).first()["x"]
        if len(text) < 3:
            return self.tables.read("tags").filter(F.contains("tag", F.lit(text))).select("tag")
        wanted = sorted({text[i : i + 3] for i in range(len(text) - 2)})
        lists = self.tables.read("grams").filter(F.col("gram").isin(wanted)).groupBy("tag").agg(F.count("*").alias("n"))
        return lists.filter((F.col("n") == len(wanted)) & F.contains("tag", F.lit(text))).select("tag")

    def search(self, *needles: str) -> DataFrame:
        """(key) of the records that have, for every needle, a tag that contains it."""
        found = [self.tables.read("holders").join(self.matching(n), "tag", "left_semi").select(self.key).distinct() for n in needles]
        return reduce(lambda a, b: a.join(b, self.key, "left_semi"), found)
