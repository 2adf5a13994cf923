"""Edits of records as expressions: each gives the new value of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import fold, none_if_empty, utrim


def add(tags: Column, tag: Column) -> Column:
    """With the trimmed tag at the end, unless it's empty or there exactly."""
    t = utrim(tag)
    return F.when((t == "") | F.array_contains(tags, t), tags).otherwise(F.array_append(tags, t))


def remove(tags: Column, tag: Column) -> Column:
    return F.filter(tags, lambda x: x != tag)


def remove_folded(tags: Column, tag: Column) -> Column:
    """Without all that equal the tag, trimmed and in lower case; `tag` and `-tag` differ. The number removed is the difference in size."""
    return F.filter(tags, lambda x: fold(x) != fold(tag))


def suppress(tags: Column, tag: Column) -> Column:
    return add(tags, F.concat(F.lit("-"), utrim(tag)))


def unsuppress(tags: Column, tag: Column) -> Column:
    return remove(tags, F.concat(F.lit("-"), utrim(tag)))


def toggle_suppression(tags: Column, tag: Column) -> Column:
    return F.when(F.array_contains(tags, F.concat(F.lit("-"), utrim(tag))), unsuppress(tags, tag)).otherwise(suppress(tags, tag))


def manual_caption(text: Column) -> Column:
    return none_if_empty(utrim(text))


add_hint, remove_hint = add, remove


def set_caption(captions: Column, key: Column, text: Column, at: Column | None = None) -> Column:
    """Replaces one entry, which is then not skipped."""
    entry = F.struct(text.alias("caption"), (F.current_timestamp() if at is None else at).alias("captioned_at"), F.lit(False).alias("skip"))
    return F.map_concat(F.map_filter(captions, lambda k, v: k != key), F.create_map(key, entry))


def remove_caption(captions: Column, key: Column) -> Column:
    return F.map_filter(captions, lambda k, v: k != key)


def toggle_skip(captions: Column, key: Column) -> Column:
    return F.transform_values(captions, lambda k, v: F.when(k == key, F.struct(v.caption.alias("caption"), v.captioned_at.alias("captioned_at"), (~F.coalesce(v.skip, F.lit(False))).alias("skip"))).otherwise(v))


def promote(mode: str, current: Column, captions: Column, key: Column) -> Column:
    """The manual caption after a run: never, if-empty or always from the entry of that key."""
    fresh = F.coalesce(manual_caption(F.try_element_at(captions, key)["caption"]), current)
    if mode == "never":
        return current
    if mode == "always":
        return fresh
    if mode == "if-empty":
        return F.when(manual_caption(current).isNull(), fresh).otherwise(current)
    raise ValueError(f"unknown mode {mode}")


def _named(tags: list[str]) -> list[str]:
    out = [t.strip() for t in tags if t.strip()]
    if not out:
        raise ValueError("at least one non-empty tag is needed")
    return out


def add_tags(records: DataFrame, tags: list[str]) -> DataFrame:
    """All records with the tags added; `changed` tells which differ."""
    now = F.col("manual_tags")
    for t in _named(tags):
        now = add(now, F.lit(t))
    return records.withColumn("_now", now).withColumn("changed", F.size("_now") != F.size("manual_tags")).withColumn("manual_tags", F.col("_now")).drop("_now")


def remove_tags(records: DataFrame, tags: list[str]) -> DataFrame:
    now = F.col("manual_tags")
    for t in _named(tags):
        now = remove_folded(now, F.lit(t))
    return records.withColumn("_now", now).withColumn("removed", F.size("manual_tags") - F.size("_now")).withColumn("manual_tags", F.col("_now")).drop("_now")


def on_selection(records: DataFrame, paths: DataFrame, edited: DataFrame, key: str = "sidecar_key") -> DataFrame:
    """The edited version of the selected records, and the others as they are."""
    chosen = paths.select(key).distinct()
    return edited.join(chosen, key, "left_semi").unionByName(records.join(chosen, key, "left_anti"), allowMissingColumns=True)


def upsert(records: DataFrame, results: DataFrame, fields: list[str], key: str = "sidecar_key") -> DataFrame:
    """Whole fields taken from results where there are any; images without a record get one. The manual layer is left alone."""
    new = results.select(key, F.lit(True).alias("_got"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = records.join(new, key, "full")
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_got"), F.col(f"_{f}")).otherwise(F.col(f)))
    return out.drop("_got", *[f"_{f}" for f in fields])
