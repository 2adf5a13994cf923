"""Exact deduplication by a stateful stream.

A streaming aggregation keeps, for each digest of a normalised text, without expiry and in a disk-backed state store: the number of rows, the
smallest doc_id and where that row's content lies (file and row). Copies meet in each task before they are shuffled, so a group that holds a
third of all rows is a few rows to the state. On hits, that is for digests of more than one row, the content that the state points to is fetched and
whole texts are compared with it byte by byte.

Defined cases: a null text counts as empty, and all empty texts are equal; null doc_ids come after all others; repeated rows are
copies, and share the mark where they share the doc_id; texts
whose digests are equal but whose bytes differ are told apart, those of a digest by the smallest doc_id of each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.bloom import among
from loomset.llm.common import settle, shared_dir

#: A store on disk; one per partition of the state, so none of them reserves disk ahead of its use.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def seen(stream: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Runs the stream over what is there now; a table (digest, keep_id, file, row, n) of its state."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/loomset/dedup-{uuid.uuid4().hex}"
    rows = stream.select(digest(normalised(F.col("text"))).alias("digest"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    state = rows.groupBy("digest").agg(F.min("at").alias("at"), F.count("*").alias("n"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.select("digest", "at", "n", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{place}/changes/{batch:09d}")

    query = state.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").start()
    query.awaitTermination()
    schema = state.withColumn("batch", F.lit(0).cast("long")).schema
    if not query.lastProgress and not query.recentProgress:
        return spark.createDataFrame([], "digest string, keep_id long, file string, row long, n long")
    latest = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{place}/changes").groupBy("digest").agg(F.max_by(F.struct("at", "n"), "batch").alias("s"))
    return latest.select("digest", F.col("s.at.doc_id").alias("keep_id"), F.col("s.at.file").alias("file"), F.col("s.at.row").alias("row"), F.col("s.n").alias("n"))


def dedup(docs: DataFrame, stream: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs' rows as (doc_id, keep_id, group_size, kept, digest); docs: a table of files, stream: the same rows as a file stream."""
    copies = settle(seen(stream, digest).filter("n > 1"), "copies")
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    hit = among(copies, "digest")
    # copies meet in each task first, so that few whole texts travel
    found = rows.filter(hit("digest")).groupBy("digest", "text").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("at"), F.count("*").alias("n"))
    # what the state points to
    there = docs.select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    pointed = among(copies, "file", "row")
    first = there.filter(pointed("file", "row")).join(copies, ["file", "row"]).select("digest", normalised(F.col("text")).alias("first"), F.col("keep_id").alias("first_id"))
    own = F.col("text") == F.col("first")
    checked = found.join(first, "digest").select("digest", "text", "n", own.alias("same"), F.when(own, F.col("first_id")).otherwise(F.col("at.doc_id")).alias("keep_id"))
    checked = settle(checked, "checked")
    # a digest of several texts is told apart by the texts themselves, any other by the digest
    clash = settle(checked.filter("NOT same").select("digest").distinct(), "clash")
    plain = checked.join(clash, "digest", "left_anti").select("digest", "keep_id", "n")
    columns = ("doc_id", "digest", "keep_id", "n")
    if clash.limit(1).count():
        odd = among(clash, "digest")
        out = rows.filter(~odd("digest")).drop("text").join(plain, "digest", "left").select(*columns)
        joined = out.unionByName(rows.filter(odd("digest")).join(checked.select("digest", "text", "keep_id", "n"), ["digest", "text"], "left").select(*columns))
    else:
        joined = rows.drop("text").join(plain, "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest"))


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """A stream over the Parquet files at path, a file or a folder, `files` in each micro-batch, in a session of its own for its state store's settings."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone"):
        if spark.conf.get(k, None) is not None:
            own.conf.set(k, spark.conf.get(k))
    for k, v in _STORE.items():
        own.conf.set(k, v)
    path = path.rstrip("/")
    # a pattern that only this path meets: a stream takes a single file only by a pattern
    return own.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text")
    return dedup(docs, file_stream(spark, path, "doc_id long, text string")).withColumnRenamed("digest", "text_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
