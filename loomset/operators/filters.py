"""Record predicates, searches, and what a run has still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import fold


def tagged() -> Column:
    return F.col("tagger").isNotNull()


def captioned() -> Column:
    return F.coalesce(F.cardinality("captions"), F.lit(0)) > 0


def has_booru() -> Column:
    return F.col("booru").isNotNull()


def _none(field: str) -> Column:
    return F.coalesce(F.size(field), F.lit(0)) == 0


def view(name: str) -> Column:
    return {
        "all": F.lit(True), "untagged": ~tagged() & _none("manual_tags"), "auto_tagged": tagged(), "no_manual": _none("manual_tags"),
        "no_caption": ~captioned(), "no_hint": _none("caption_hints"), "no_booru": ~has_booru(),
    }[name]


VIEWS = ("all", "untagged", "auto_tagged", "no_manual", "no_caption", "no_hint", "no_booru")


def search(needle: str) -> Column:
    """Records with a tag of any source that contains the needle, in any case; manual tags with their signs."""
    n = fold(F.lit(needle))
    return F.exists("manual_tags", lambda t: F.contains(F.lower(t), n)) | F.exists("auto_tags", lambda x: F.contains(F.lower(x.tag), n)) | F.exists("booru_tags", lambda x: F.contains(F.lower(x.tag), n))


def pending(images: DataFrame, records: DataFrame, captioner: str, prompts: list[tuple[str, str]], force: bool = False) -> DataFrame:
    """(image, prompt) for which no caption is held yet. prompts are a configured list, so the product grows with the images alone."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("prompt"), F.lit(t).alias("prompt_text"), F.lit(f"{captioner}.{n}").alias("caption_key")) for n, t in prompts]))
    wanted = images.select("*", names.alias("p")).select("*", "p.*").drop("p")
    if force:
        return wanted
    held = records.select("sidecar_key", F.explode(F.map_keys("captions")).alias("caption_key"))
    return wanted.join(held, ["sidecar_key", "caption_key"], "left_anti")


def move_plan(matches: DataFrame, existing: DataFrame, source: str, target: str) -> DataFrame:
    """Matched images with src, dst and action (move, or skip where image or record exist there): pairs stay together."""
    from loomset.functions.paths import relative, sidecar_key

    moved = matches.withColumn("dst", F.concat(F.lit(target.rstrip("/") + "/"), relative(F.col("image_path"), source)))
    there = existing.select(F.col("image_path").alias("dst"), F.lit(True).alias("_image"))
    records = existing.filter("has_record").select(F.col("sidecar_key").alias("_key"), F.lit(True).alias("_record")).distinct()
    out = moved.withColumn("_key", sidecar_key(F.col("dst"))).join(there, "dst", "left").join(records, "_key", "left")
    clash = F.coalesce("_image", F.lit(False)) | (F.col("has_record") & F.coalesce("_record", F.lit(False)))
    return out.select(F.col("image_path").alias("src"), "dst", "has_record", F.when(clash, "skip").otherwise("move").alias("action"))


def upscale_plan(images: DataFrame, existing: DataFrame, source: str, output: str, force: bool = False) -> DataFrame:
    """Images outside the output folder with their PNG targets; existing targets, and the later of two images with one target, are skipped."""
    from pyspark.sql import Window as W

    from loomset.functions.paths import relative, with_extension

    inside = F.startswith(F.col("image_path"), F.lit(output.rstrip("/") + "/"))
    planned = images.filter(~inside).withColumn("dst", with_extension(F.concat(F.lit(output.rstrip("/") + "/"), relative(F.col("image_path"), source)), "png"))
    n = F.row_number().over(W.partitionBy("dst").orderBy("image_path"))
    there = existing.select(F.col("image_path").alias("dst"), F.lit(True).alias("_there"))
    out = planned.withColumn("_n", n).join(there, "dst", "left")
    skip = F.lit(False) if force else F.coalesce("_there", F.lit(False)) | (F.col("_n") > 1)
    return out.select(F.col("image_path").alias("src"), "dst", F.when(skip, "skip").otherwise("upscale").alias("action"))
