"""Connected components of a graph of links, by contraction, in tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import ready, settle

#: Links that are few enough for one task, which spares a small graph the rounds.
FEW_LINKS = 1 << 14


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node of the component of each node of these links."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while to.setdefault(x, x) != x:
            to[x] = x = to[to[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            to[max(a, b)] = min(a, b)
    nodes = list(to)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "to"])


def _edges(links: DataFrame) -> DataFrame:
    return settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): the smallest node of its component, for all nodes with a link.

    In each round a node moves to the first node, in the order of a hash, among itself and its neighbours, and then to where that one moved; links
    between nodes that moved to the same place are done with, so rounds shrink, whatever the order of the ids. Once FEW_LINKS or less are left, one
    task follows them. Then the moves are followed to their ends. All stays in tables; the driver sees how many links remain.
    """
    ready(links.sparkSession)
    edges, moves = settle(links.filter("a <> b").select("a", "b"), "links"), []
    if edges.count() > FEW_LINKS:
        edges = _edges(edges)
    placed = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("id"))
    while n := edges.count():
        if n <= FEW_LINKS:
            moves.append(settle(edges.coalesce(1).mapInArrow(_followed, "node long, to long"), "moves"))
            break
        both = edges.union(edges.select("b", "a"))
        near = settle(both.groupBy("a").agg(F.min(placed("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", placed("a"))["id"].alias("to")), "moves")
        further = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = settle(near.join(further, "to").select("node", F.col("further").alias("to")), "moves")
        moves.append(moved)
        ends = [moved.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b")]
        edges = _edges(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = moves.pop()
    if n and not moves:  # one task followed all links
        return found.withColumnRenamed("to", "label")
    while moves:
        last = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = settle(moves.pop().join(last, "to", "left").select("node", F.coalesce("last", "to").alias("to")), "moves")
    least = found.groupBy("to").agg(F.min("node").alias("label"))
    return settle(found.join(least, "to").select("node", "label"), "labels")
