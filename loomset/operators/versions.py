"""An edit log over record versions: edits apply only to the version that they were made for.

A log has rows (batch, sidecar_key, expected, seq, op, value): edits of a batch on a record apply together, in order of seq, if the record's digest is
the expected one. Of several batches for one version the first by batch wins. What doesn't apply comes back as rows, so no edit is lost in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.operators import edits
from loomset.storage import Scratch

LOG = "batch long, sidecar_key string, expected string, seq int, op string, value string"
OPS = {"add": edits.add, "remove": edits.remove_folded, "suppress": edits.suppress, "unsuppress": edits.unsuppress}


def _tags(tags: Column, steps: Column) -> Column:
    """Manual tags after the steps (op, value), one after the other."""

    def step(now: Column, e: Column) -> Column:
        out = now
        for name, f in OPS.items():
            out = F.when(e.op == name, f(now, e.value)).otherwise(out)
        return out

    return F.aggregate(steps, tags, step)


def apply(records: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records (with digest), log -> (edited records, those alone; conflicts as (batch, sidecar_key, reason)).

    Reasons: changed (another version is there), overtaken (an earlier batch got this version), missing (no such record), unknown op (the batch applies nothing).
    """
    with Scratch(log.sparkSession) as run:
        known = F.col("op").isin(*OPS, "caption")
        batches = log.groupBy("sidecar_key", "batch").agg(F.min(F.coalesce("expected", F.lit(""))).alias("expected"), F.max(F.coalesce("expected", F.lit(""))).alias("_most"), F.bool_and(known).alias("known"), F.sort_array(F.collect_list(F.struct("seq", "op", "value"))).alias("steps"))
        judged = batches.join(records.select("sidecar_key", "digest"), "sidecar_key", "left")
        reason = F.when(~F.col("known"), "unknown op").when(F.col("digest").isNull(), "missing").when((F.col("expected") != F.col("digest")) | (F.col("_most") != F.col("digest")), "changed")
        judged = judged.withColumn("reason", reason)
        place = F.row_number().over(W.partitionBy("sidecar_key", F.col("reason").isNull()).orderBy("batch"))
        judged = run.settle(judged.withColumn("reason", F.when(F.col("reason").isNull() & (place > 1), "overtaken").otherwise(F.col("reason"))), "batches", keep=True)
    takes = judged.filter("reason IS NULL").select("sidecar_key", "steps")
    last = F.element_at(F.filter("steps", lambda e: e.op == "caption"), -1)
    fresh = F.when(F.exists("steps", lambda e: e.op == "caption"), edits.manual_caption(last["value"])).otherwise(F.col("manual_caption"))
    edited = records.join(takes, "sidecar_key").withColumns({"manual_tags": _tags(F.col("manual_tags"), F.col("steps")), "manual_caption": fresh}).drop("steps")
    return edited, judged.filter("reason IS NOT NULL").select("batch", "sidecar_key", "reason")
