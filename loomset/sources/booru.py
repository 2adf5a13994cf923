"""External posts, joined by the MD5 of an image's bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import flatten

#: Tag fields of a post, in the order in which their tags are listed.
FIELDS = ("artist", "copyright", "character", "general", "meta")


def post_tags() -> Column:
    """The tags of columns tag_string_<category>, as array of (tag, category)."""
    one = lambda c: F.transform(F.filter(F.split(flatten(F.coalesce(F.col(f"tag_string_{c}"), F.lit(""))), " "), lambda t: t != ""), lambda t: F.struct(t.alias("tag"), F.lit(c).alias("category")))
    return F.concat(*[one(c) for c in FIELDS])


def lookup(images: DataFrame, posts: DataFrame) -> DataFrame:
    """images (content) with md5 and the columns of the post of that md5, null where there is none. Bytes are hashed where they lie and don't move."""
    hashed = images.withColumn("md5", F.md5("content")).drop("content")
    return hashed.join(posts, "md5", "left")


def to_record(matched: DataFrame, base_url: str, source: str = "danbooru") -> DataFrame:
    """(sidecar_key, booru_tags, booru) of images with a post: what an upsert of records takes."""
    info = F.struct(F.lit(source).alias("source"), F.col("id").cast("long").alias("post_id"), F.concat(F.lit(f"{base_url.rstrip('/')}/posts/"), F.col("id").cast("string")).alias("post_url"), F.current_timestamp().alias("fetched_at"))
    return matched.filter("id IS NOT NULL").select("sidecar_key", post_tags().alias("booru_tags"), info.alias("booru"))
