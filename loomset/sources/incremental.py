"""Record files loaded again without parsing what hasn't changed.

The state is a table, in versions, of each file's path, size, time and digest, with its record. A load lists the folder (without contents), keeps the
records of files whose size and time are as before, reads the others, and parses those with a new digest. Files that are gone lose their records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.paths import sidecar_key
from loomset.sources import records
from loomset.storage import Scratch, Versions


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified) of all record files, from the file system alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ron").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _contents(files: DataFrame) -> DataFrame:
    """(path, bytes, modified) with digest and value; files that went meanwhile are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([records.digest(data)]), pa.array([data.decode("utf-8", "replace")])], [*row.schema.names, "digest", "value"])

    return files.mapInArrow(run, "path string, bytes long, modified timestamp, digest string, value string")


def load(spark: SparkSession, folder: str, state: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records with path and digest; changes as (path, change)): added, changed (parsed), touched (a new time, the same bytes: not parsed) and deleted."""
    held = Versions(spark, state)
    before = held.read("files")
    with Scratch(spark) as run:
        now = run.settle(listing(spark, folder), "listing")
        if before is None:
            old = kept = None
            fresh = now
        else:
            old = before.select("path", "bytes", "modified", F.col("digest").alias("was"))
            kept = before.join(now, ["path", "bytes", "modified"], "left_semi")
            fresh = now.join(old, ["path", "bytes", "modified"], "left_anti")
        found = run.settle(_contents(fresh.repartition("path")), "contents")
        if old is not None:
            found = found.join(old.select("path", "was"), "path", "left")
        else:
            found = found.withColumn("was", F.lit(None).cast("string"))
        change = F.when(F.col("was").isNull(), "added").when(F.col("was") == F.col("digest"), "touched").otherwise("changed")
        found = run.settle(found.withColumn("change", change), "found")
        texts = found.filter("change <> 'touched'").select(sidecar_key(F.col("path")).alias("key"), "value")
        parsed = records.parsed(texts, strict).join(found.filter("change <> 'touched'").select(sidecar_key(F.col("path")).alias("sidecar_key"), "path", "bytes", "modified", "digest"), "sidecar_key")
        files = parsed
        changes = found.select("path", "change")
        if before is not None:
            touched = before.drop("bytes", "modified").join(found.filter("change = 'touched'").select("path", "bytes", "modified"), "path")
            files = parsed.unionByName(kept).unionByName(touched)
            changes = changes.unionByName(before.join(now, "path", "left_anti").select("path", F.lit("deleted").alias("change")))
        held.write(files=files, changes=changes)
    return held.read("files").drop("bytes", "modified"), held.read("changes")
