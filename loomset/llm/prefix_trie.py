"""The trie of conversations' prefixes, built level by level, with what sharing a prefix saves.

A node is a distinct sequence of first turns. At each depth the conversations that are still live are grouped by (parent node, next turn); the
smallest conv_id of a group names the child. Where all members of a node are the same conversation to its end, the chain of nodes below it is
known, so its members leave the levels: copies and single conversations cost no further level, however long they are. Then leaves and savings
are rolled up from the deepest level by joins of a level with the one above. Every level is a table in the shared folder.

Turns are told apart by the SHA-256 of (role, text), so no text is shuffled. Groups are aggregated before they are shuffled, and members learn
their child by a join that AQE can split, so a turn with which a third of all conversations begin is no single task. A conversation's turns are
one row of digests. The digest of the ids that end at a node follows the ids in order, so one task streams a node's ids, and holds none of them.

Defined cases: a null role or text is empty; turns are ordered by (turn, role, digest), null turns first, so ties and repeated rows have one
order; repeated rows are turns of their own; rows with a null conv_id belong to no conversation; an empty table gives no rows, not even a root;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import ready, settle

#: Turns of another conversation that a rebuilt one starts with, at most.
MOST_SHARED = 8


def sequences(turns: DataFrame) -> DataFrame:
    """(conv, steps): each conversation's turns in order, as (d: digest of role and text, b: bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    step = F.struct(F.col("turn"), role.alias("role"), digest.alias("d"), F.octet_length(text).cast("long").alias("b"))
    grouped = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), step.alias("s")).groupBy("conv").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return grouped.select("conv", F.transform("s", lambda x: F.struct(x.d.alias("d"), x.b.alias("b"))).alias("steps"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns from conversation c - c % 5, h being crc32(c) % 9, and its own after these."""
    seqs = settle(seqs, "turns")
    heads = seqs.select(F.col("conv").alias("of"), F.slice("steps", 1, MOST_SHARED).alias("head"))
    own = seqs.withColumns({"of": F.col("conv") - F.col("conv") % 5, "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")})
    head = F.when(F.col("head").isNull(), F.slice("steps", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return own.join(heads, "of", "left").select("conv", F.concat(head, F.slice("steps", F.col("h") + 1, F.size("steps"))).alias("steps"))


def _after(steps: Column) -> Column:
    """Bytes of all steps."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.b)


ENDS = "depth long, conv long, ends string"


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, node, conv), sorted -> a digest for each (depth, node): a running hash, whatever the number of ids."""
    at, running, out = None, None, []
    for batch in batches:
        depth, node = (batch.column(c).to_numpy() for c in ("depth", "node"))
        ids = batch.column("conv").cast(pa.string()).to_pylist()
        edges = np.flatnonzero((np.diff(depth, prepend=-1) != 0) | (np.diff(node, prepend=0) != 0))
        edges = [0, *edges[edges > 0].tolist(), len(ids)] if ids else []
        for i, j in zip(edges, edges[1:], strict=False):
            here, part = (int(depth[i]), int(node[i])), ",".join(ids[i:j]).encode()
            if here == at:
                running.update(b",")
            else:
                if at is not None:
                    out.append((*at, running.hexdigest()))
                at, running = here, hashlib.sha256()
            running.update(part)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["depth", "conv", "ends"])
            out = []
    if at is not None:
        out.append((*at, running.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["depth", "conv", "ends"])


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def build(seqs: DataFrame) -> DataFrame:
    """(conv, steps) -> a row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ready(seqs.sparkSession)
    whole = F.sha2(F.to_binary(F.array_join(F.transform("steps", lambda x: F.hex(x.d)), ""), F.lit("hex")), 256)
    first = seqs.select("conv", "steps", whole.alias("whole"))
    live = settle(first.withColumn("node", F.lit(0).cast("long")), "live")
    top = live.agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    root = top.first()
    # the root is called 0 while levels are built: at depth 1 every live conversation has it as its parent
    ended, levels, moves, depth = [live.filter(F.size("steps") == 0).select(F.lit(0).cast("long").alias("depth"), F.lit(root["conv"]).cast("long").alias("node"), "conv")], [], [], 0
    while True:
        depth += 1
        going = live.filter(F.size("steps") > 0).withColumn("turn", F.col("steps")[0]["d"])
        same = F.min("whole") == F.max("whole")
        groups = settle(going.groupBy("node", "turn").agg(F.min("conv").alias("child"), F.count("*").alias("n"), F.max(F.col("steps")[0]["b"]).alias("b"), same.alias("done")), "nodes")
        kinds = {r["done"]: r["count"] for r in groups.groupBy("done").count().collect()}
        if not kinds:
            break
        # of members whose way is known only one carries its turns on
        carried = F.when(~F.col("done") | (F.col("conv") == F.col("child")), F.slice("steps", F.lit(2), F.size("steps")))
        moved = settle(going.join(groups, ["node", "turn"]).select("conv", F.when(~F.col("done"), F.col("whole")).alias("whole"), "node", "child", "n", "b", "done", carried.alias("steps"), (F.size("steps") - 1).cast("long").alias("left")), "moved")
        levels.append(groups.filter("NOT done").select("node", "child", "n", "b"))
        moves.append(moved)
        live = moved.filter("NOT done").select("conv", "steps", "whole", F.col("child").alias("node"))
        at = F.lit(depth).cast("long")
        ended.append(live.filter(F.size("steps") == 0).select(at.alias("depth"), "node", "conv"))
        ended.append(moved.filter("done AND n > 1").select((at + F.col("left")).alias("depth"), F.col("child").alias("node"), "conv"))
        if not kinds.get(False):
            break
    return _rolled_up(live.sparkSession, root, ended, levels, moves)


def _rolled_up(spark, root, ended: list[DataFrame], levels: list[DataFrame], moves: list[DataFrame]) -> DataFrame:
    long = lambda x: (F.lit(x) if not isinstance(x, Column) else x).cast("long")
    nodes, below = [], None
    for depth in range(len(moves), 0, -1):
        alone = moves[depth - 1].filter("done AND conv = child")
        tops = alone.select("node", long(1).alias("leaves"), ((F.col("n") - 1) * (F.col("b") + _after(F.col("steps")))).alias("saved"))
        inner = None
        if below is not None:
            inner = settle(levels[depth - 1].join(below, "child").select("node", "child", "n", "children", "leaves", (F.col("saved") + (F.col("n") - 1) * F.col("b")).alias("saved")), "level")
            nodes.append(inner.select(long(depth).alias("depth"), F.col("child").alias("conv"), F.col("node").alias("parent"), "n", "children", "leaves", "saved"))
            tops = tops.unionByName(inner.select("node", "leaves", "saved"))
        below = tops.groupBy(F.col("node").alias("child")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # a chain: its nodes have one member list, one leaf, and save what stands from them to its end
        place = F.explode(F.sequence(F.lit(0), F.size("steps")))
        chain = alone.withColumn("i", place).select(
            (long(depth) + F.col("i")).alias("depth"), F.col("child").alias("conv"), F.when(F.col("i") == 0, F.col("node")).otherwise(F.col("child")).alias("parent"), "n",
            F.when(F.col("i") < F.size("steps"), long(1)).otherwise(long(0)).alias("children"), long(1).alias("leaves"),
            ((F.col("n") - 1) * (F.when(F.col("i") == 0, F.col("b")).otherwise(F.lit(0)) + _after(F.slice("steps", F.greatest(F.col("i"), F.lit(1)), F.size("steps"))))).alias("saved"),
        )
        nodes.append(chain)
    start = [long(0).alias("depth"), long(root["conv"]).alias("conv"), long(None).alias("parent"), long(root["n"]).alias("n")]
    if below is not None:
        nodes.append(below.filter("child = 0").select(*start, "children", "leaves", "saved"))
    else:
        nodes.append(spark.range(1 if root["n"] else 0).select(*start, long(0).alias("children"), long(1).alias("leaves"), long(0).alias("saved")))
    singles = [m.filter("done AND n = 1").select((long(d + 1) + F.col("left")).alias("depth"), F.col("child").alias("conv"), F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends")) for d, m in enumerate(moves)]
    streamed = _all(ended).repartition("depth", "node").sortWithinPartitions("depth", "node", "conv").mapInArrow(_hash_ends, ENDS)
    ends = _all([streamed, *singles])
    parent = F.when(F.col("depth") == 1, long(root["conv"])).otherwise(F.col("parent"))
    return _all(nodes).join(ends, ["depth", "conv"], "left").select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def trie(turns: DataFrame) -> DataFrame:
    """The trie of turns (conv_id, turn, role, text) as they are."""
    return build(sequences(turns))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the start of another."""
    return build(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))))


OP13_SQL = r"""
WITH bits AS (
  SELECT i, (WITH RECURSIVE r(k, v) AS (SELECT 0, i::BIGINT UNION ALL SELECT k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM r WHERE k < 8) SELECT v FROM r WHERE k = 8) AS v FROM range(256) t(i)
), tab AS (SELECT list(v ORDER BY i) AS tab FROM bits),
own AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, ''))::BIGINT AS b,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, y: xor(a // 256, tab.tab[(xor(a % 256, y) + 1)::INT]), 4294967295), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM own), tab
), turns AS (
  SELECT v.c, o.d, o.b, o.i FROM convs v JOIN own o ON o.c = v.c - v.c % 5 AND o.i <= v.h UNION ALL SELECT v.c, o.d, o.b, o.i FROM convs v JOIN own o ON o.c = v.c AND o.i > v.h
), steps AS (
  SELECT c, b, row_number() OVER (PARTITION BY c ORDER BY i) AS k, sha256(string_agg(d, ',') OVER (PARTITION BY c ORDER BY i)) AS p FROM turns
), paths AS (
  SELECT c, 0 AS k, '' AS p, NULL AS up, 0::BIGINT AS b, coalesce((SELECT max(s.k) FROM steps s WHERE s.c = v.c), 0) AS n FROM convs v
  UNION ALL SELECT c, k, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY k), ''), b, max(k) OVER (PARTITION BY c) FROM steps
), nodes AS (
  SELECT k, p, any_value(up) AS up, min(c) AS c, count(*)::BIGINT AS n, max(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (k = n), '')) AS ends FROM paths GROUP BY k, p
), kids AS (SELECT k - 1 AS k, up AS p, count(*)::BIGINT AS kids FROM nodes WHERE k > 0 GROUP BY ALL),
below AS (
  SELECT a.k, a.p, count(*) FILTER (m.kids IS NULL)::BIGINT AS leaves, sum((x.n - 1) * x.b)::BIGINT AS saved
  FROM nodes x LEFT JOIN kids m ON m.k = x.k AND m.p = x.p JOIN paths a ON a.c = x.c AND a.k <= x.k GROUP BY a.k, a.p
)
SELECT x.c AS conv_id, x.k::BIGINT AS depth, u.c AS parent_conv_id, x.n AS n_convs, coalesce(m.kids, 0)::BIGINT AS n_children, w.leaves AS n_leaves, w.saved AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below w ON w.k = x.k AND w.p = x.p LEFT JOIN kids m ON m.k = x.k AND m.p = x.p LEFT JOIN nodes u ON u.k = x.k - 1 AND u.p = x.up
"""
