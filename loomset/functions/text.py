"""Text primitives as column expressions: Unicode trimming, folding, flattening and stems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def utrim(c: Column) -> Column:
    """Without leading and trailing Unicode white space (trim() would leave tabs and wide spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    return F.lower(utrim(c))


def flatten(c: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(utrim(c), r"(?U)\s+", " ")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def stem(c: Column, prefixes: dict[str, str]) -> Column:
    """What tags are compared by: trimmed, without the first prefix that matches in order of category, lower case."""
    t = utrim(c)
    cut = reduce(lambda rest, p: F.when(F.startswith(t, F.lit(p)), F.substr(t, F.lit(len(p) + 1))).otherwise(rest), [prefixes[k] for k in sorted(prefixes)][::-1], t)
    return F.lower(cut)


def affix_stem(c: Column) -> Column:
    """What caption affixes are matched by: trimmed, without one leading underscore, lower case."""
    return F.lower(F.regexp_replace(utrim(c), "^_", ""))


def spaced(tags: Column) -> Column:
    """Tags as one line for trainers: underscores become spaces."""
    return F.array_join(F.transform(tags, lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", ")


def keep_first(items: Column, key: str) -> Column:
    """Array of structs: the first of each key."""
    keys = F.transform(items, lambda x: x[key])
    return F.filter(items, lambda x, i: F.array_position(keys, x[key]) == i + 1)


def by_key(mapping: Column) -> Column:
    """A map's entries in byte order of their keys; maps themselves have no useful order."""
    return F.array_sort(F.map_entries(mapping), lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))
