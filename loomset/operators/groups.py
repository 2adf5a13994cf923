"""Tag groups: classification, buckets, and edits that move a record to another bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import fold, utrim
from loomset.operators import edits
from loomset.operators.tags import effective


def classify(records: DataFrame, group: list[str], name: str = "classification") -> DataFrame:
    """state (tag, unset, violation), tag and tags of an exclusive group, in the group's order and spelling."""
    held = records.withColumn("_e", effective(F.col("manual_tags"), F.col("auto_tags"), F.col("booru_tags")))
    present = F.filter(F.array(*map(F.lit, group)), lambda g: F.array_contains(F.col("_e"), fold(g)))
    held = held.withColumn("_p", present)
    n = F.size("_p")
    state = F.when(n == 0, "unset").when(n == 1, "tag").otherwise("violation")
    return held.withColumn(name, F.struct(state.alias("state"), F.when(n == 1, F.col("_p")[0]).alias("tag"), F.when(n > 1, F.col("_p")).alias("tags"))).drop("_e", "_p")


def totals(classified: DataFrame, name: str = "classification") -> DataFrame:
    return classified.groupBy(F.col(f"{name}.state").alias("state")).agg(F.count("*").alias("n"))


def problems(classified: DataFrame, name: str = "classification") -> DataFrame:
    return classified.filter(F.col(f"{name}.state") != "tag")


def bucket(name: str = "classification") -> Column:
    """A board's column: the tag, or the state."""
    return F.coalesce(F.col(f"{name}.tag"), F.col(f"{name}.state"))


def apply_drop(records: DataFrame, group: list[str], target: str | None) -> DataFrame:
    """manual_tags so that the record is classified as target (None: unset).

    The effective set is that before the edit. As in interactive edits, removal compares exactly: an entry that differs in case stays.
    """
    held = records.withColumn("_e", effective(F.col("manual_tags"), F.col("auto_tags"), F.col("booru_tags")))
    tags = F.col("manual_tags")
    own = target.strip() if target is not None else None
    if own == "":
        return records
    if own is not None:
        tags = edits.add(edits.unsuppress(tags, F.lit(own)), F.lit(own))
    for other in dict.fromkeys(g.strip() for g in group):
        if other and (own is None or other.lower() != own.lower()):
            there = F.array_contains(F.col("_e"), fold(F.lit(other)))
            tags = F.when(there, edits.suppress(edits.remove(tags, F.lit(other)), F.lit(other))).otherwise(tags)
    return held.withColumn("manual_tags", tags).drop("_e")


def move_matches(records: DataFrame, wanted: list[str]) -> DataFrame:
    """Records whose effective set holds all wanted tags."""
    folded = [x for x in (t.strip().lower() for t in wanted) if x]
    if not folded:
        raise ValueError("at least one non-empty tag is needed")
    eff = effective(F.col("manual_tags"), F.col("auto_tags"), F.col("booru_tags"))
    return records.filter(F.size(F.array_intersect(eff, F.array(*map(F.lit, dict.fromkeys(folded))))) == len(dict.fromkeys(folded)))


def trimmed(tags: Column) -> Column:
    return F.transform(tags, lambda t: utrim(t))
