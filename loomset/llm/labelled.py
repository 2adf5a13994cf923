"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import part


def sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, most: int, balanced: bool) -> tuple[DataFrame, dict[int, int]]:
    """docs with label, of about `most` labelled rows outside the held-out part, and the number of rows of each label.

    Rows are taken by a hash of their id, below a threshold that follows from the counts; balanced: as many of either label, as far as there
    are. The ids taken are at most a little over `most`, so they are broadcast. Labels that contradict each other: the larger counts.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (part("doc_id", modulus) != held)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    taken = F.lit(False)
    for label, n in counts.items():
        share = min(1.0, (most / len(counts) / n) if balanced else most / total)
        taken = taken | ((F.col("label") == label) & (place < int(share * (1 << 30))))
    ids = known.filter(taken)
    return docs.join(F.broadcast(ids), "doc_id"), counts
