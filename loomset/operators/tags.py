"""Tags: suppression, effective sets, and the ordered list that is exported.

Everything is an expression over one record's arrays: no explode and no shuffle. `exported_long` is the same in long form, for very wide lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.config import ExportProfile
from loomset.functions.text import fold, keep_first, spaced, stem, utrim

_TAG = "array<struct<stem:string,shown:string>>"


def positives(manual: Column) -> Column:
    """Manual tags that don't suppress, as they are."""
    return F.filter(manual, lambda t: ~F.startswith(utrim(t), F.lit("-")))


def suppressed(manual: Column) -> Column:
    """Folded tags that manual entries `-tag` suppress."""
    negative = F.filter(manual, lambda t: F.startswith(utrim(t), F.lit("-")))
    return F.array_distinct(F.filter(F.transform(negative, lambda t: fold(F.substr(utrim(t), F.lit(2)))), lambda t: t != ""))


def is_suppressed(tag: Column, manual: Column) -> Column:
    return F.array_contains(suppressed(manual), fold(tag))


def is_organizational(tag: Column) -> Column:
    return F.startswith(utrim(tag), F.lit("_"))


def effective(manual: Column, auto: Column, booru: Column) -> Column:
    """Folded tags of all sources less the suppressed; no threshold, no category rule."""
    folded = lambda a, f=lambda x: x: F.filter(F.transform(a, lambda x: fold(f(x))), lambda t: t != "")
    every = F.array_union(F.array_union(folded(positives(manual)), folded(auto, lambda x: x.tag)), folded(booru, lambda x: x.tag))
    return F.array_sort(F.array_except(every, suppressed(manual)))


def shown(tag: Column, category: Column, profile: ExportProfile) -> Column:
    """An external tag with its category's prefix."""
    out = tag
    for k, p in profile.category_prefixes.items():
        out = F.when(category == k, F.concat(F.lit(p), tag)).otherwise(out)
    return out


def candidates(profile: ExportProfile, manual: Column, auto: Column, booru: Column) -> Column:
    """Manual, automatic and external tags in order, as (stem, shown), before the first of each stem is kept."""
    prefixes = profile.category_prefixes
    out = suppressed(manual)
    pair = lambda text: F.struct(stem(text, prefixes).alias("stem"), text.alias("shown"))
    own = F.filter(F.transform(positives(manual), lambda t: utrim(t)), lambda t: (t != "") & ~is_organizational(t))
    allowed = lambda x: ~F.array_contains(out, F.lower(x.tag)) & (~x.category.isin(*profile.exclude_categories) if profile.exclude_categories else F.lit(True))
    scored = F.filter(auto, lambda x: (x.score >= F.lit(profile.threshold).cast("float")) & allowed(x))
    return F.concat(
        F.transform(own, pair).cast(_TAG),
        F.transform(scored, lambda x: pair(shown(x.tag, x.category, profile))).cast(_TAG),
        F.transform(F.filter(booru, allowed), lambda x: pair(shown(x.tag, x.category, profile))).cast(_TAG),
    )


def build_tags(records: DataFrame, profile: ExportProfile, name: str = "tags", seed: int | None = None) -> DataFrame:
    """records with the exported tags; the candidates are a column first, so that lambdas don't compute them again for each element."""
    held = records.withColumn("_c", candidates(profile, F.col("manual_tags"), F.col("auto_tags"), F.col("booru_tags")))
    tags = F.transform(keep_first(F.col("_c"), "stem"), lambda x: x.shown)
    return held.withColumn(name, F.shuffle(tags, F.lit(seed)) if profile.shuffle and seed is not None else F.shuffle(tags) if profile.shuffle else tags).drop("_c")


def exported_long(records: DataFrame, profile: ExportProfile, key: str = "sidecar_key") -> DataFrame:
    """(key, ord, tag) by a window over (key, stem): the long form of build_tags."""
    long = records.select(key, F.posexplode(candidates(profile, F.col("manual_tags"), F.col("auto_tags"), F.col("booru_tags"))).alias("ord", "c"))
    first = W.partitionBy(key, "c.stem").orderBy("ord")
    return long.withColumn("n", F.row_number().over(first)).filter("n = 1").select(key, "ord", F.col("c.shown").alias("tag"))


def export_text(records: DataFrame, profile: ExportProfile) -> DataFrame:
    return build_tags(records, profile).withColumn("text", spaced(F.col("tags")))
