"""Columns of the caller's that have the names of an operator's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def apart(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with clashing columns under other names, and the way back to all of docs' columns and no others."""
    own, wanted = {c.lower() for c in docs.columns}, {n.lower() for n in names}
    other = {}
    for c in docs.columns:
        if c.lower() in wanted:
            fresh = c + "_"
            while fresh.lower() in own | wanted:
                fresh += "_"
            own.add(fresh.lower())
            other[c] = fresh
    columns = docs.columns
    renamed = docs.withColumnsRenamed(other)
    return renamed, lambda out: out.select(*[out[other.get(c, c)].alias(c) for c in columns])
