"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines decides where a chunk ends, so boundaries depend on content alone and come back after
insertions. A line of at least LONG words is a chunk of its own. Chunks that recur anywhere in the corpus, of several lines with at least WORDS
words together or of one long line, are compared byte by byte; the first, by (doc_id, place), stays and the others are cut from their texts.

A passage's first and last chunks reach into its neighbours, so with `passages` a finer level follows: from every line on, and up to every line,
the fewest lines that have LONG words. Any run of lines with LONG words or more consists of such windows, wherever it stands, so each of its lines
is cut if the run stood earlier. A copy that overlaps the window that stays loses only the lines beyond it.

Defined cases: null and empty texts have no chunks and stay as they are; rows with the same doc_id and text count as one document and are
treated alike; null doc_ids come after all others; chunks with equal hashes but different bytes are told apart by a second hash, and left alone where
that is equal too; whole texts of any length count;
an empty table gives no rows; further columns are carried unless their names are those added here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomset.llm.bloom import MOST_BITS, among
from loomset.llm.common import SPACE, _powers, blocks, hashes, mix, ready, settle, spans

#: A chunk ends after one line in so many, on average.
EVERY = 4
#: Words of a passage, and of a chunk of several lines, at least, unless others are given.
LONG = 50
WORDS = 20
ADDED = ("n_lines", "n_removed")


def chunks(data: np.ndarray, limits: np.ndarray, passages: bool = False, long: int = LONG) -> dict[str, np.ndarray]:
    """All chunks: row, hash, first and last line (within the row), begin and end byte, words. With passages: then all windows of several lines."""
    n = len(limits) - 1
    nonempty = np.diff(limits) > 0
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([limits[:-1][nonempty], breaks + 1]))
    ends = np.sort(np.concatenate([limits[1:][nonempty], breaks]))
    # a break at a row's end begins an empty last line, which is where the next row begins: order by row, then place
    row = np.repeat(np.arange(n), np.where(nonempty, 1 + np.diff(np.searchsorted(breaks, limits)), 0))
    if not len(row):
        return {k: np.zeros(0, np.int64) for k in ("row", "hash", "first", "last", "begin", "end", "words")}
    h = hashes(data, begins, ends, fold=False)
    starts, _, _ = spans(~SPACE[data], limits)
    count = np.searchsorted(starts, ends) - np.searchsorted(starts, begins)
    alone = count >= long
    rolled = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], 6)
    cut = alone.copy()
    cut[1:] |= (rolled % np.uint64(EVERY) == 0) & (row[1:] == row[:-1])
    cut[:-1] |= alone[1:] | (row[1:] != row[:-1])
    cut[-1] = True
    final = np.flatnonzero(cut)
    lead = np.concatenate([[0], final[:-1] + 1])
    words = np.concatenate([[0], np.cumsum(count)])
    seed = np.full(len(lead), 62)
    if passages:
        a, b = _windows(words, row, long)
        lead, final, seed = np.concatenate([lead, a]), np.concatenate([final, b]), np.concatenate([seed, np.full(len(a), 63)])
    power, inverse = _powers(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, 61) * power[: len(h)])])
    value = (total[final + 1] - total[lead]) * inverse[lead] + (final - lead).astype(np.uint64)
    value = np.where(seed == 62, mix(value, 62), mix(value, 63))
    origin = np.searchsorted(row, np.arange(n))  # each row's first line
    return {"row": row[lead], "hash": value.view(np.int64), "first": lead - origin[row[lead]], "last": final - origin[row[lead]], "begin": begins[lead], "end": ends[final], "words": words[final + 1] - words[lead]}


def _windows(words: np.ndarray, row: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the least runs of several lines with `long` words that begin or end at a line. words: before each line, and in all."""
    n = len(row)
    line = np.arange(n)
    ahead = np.searchsorted(words[1:], words[:-1] + long)
    back = np.searchsorted(words[:-1], words[1:] - long, "right") - 1
    a, b = np.concatenate([line, np.maximum(back, 0)]), np.concatenate([np.minimum(ahead, n - 1), line])
    ok = (np.concatenate([ahead < n, back >= 0])) & (a < b)
    ok &= row[a] == row[b]
    key = np.unique(a[ok] * n + b[ok])
    return key // n, key % n


def _eligible(c: dict[str, np.ndarray], long: int, few: int) -> np.ndarray:
    return np.flatnonzero((c["words"] >= long) | ((c["last"] > c["first"]) & (c["words"] >= few)))


def _likely(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A filter of hashes in Python workers, of bounded size like bloom.among: true for all keys and few others."""
    bits = min(MOST_BITS, 1 << max(16, int(np.ceil(np.log2(16 * max(1, keys.count()))))))
    spot = [F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1))]
    cells = keys.select(F.explode(F.array(*spot)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[np.asarray(cells.column("w"))] = np.asarray(cells.column("mask"))
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def likely(h: np.ndarray) -> np.ndarray:
        h, out = h.view(np.uint64), np.ones(len(h), bool)
        for x in (h, h >> np.uint64(32)):
            at = (x & np.uint64(bits - 1)).astype(np.int64)
            out &= (shared.value[at >> 6] >> (at & 63)) & 1 == 1
        return out

    return likely


def dedup_lines(docs: DataFrame, passages: bool = False, long: int = LONG, few: int = WORDS) -> DataFrame:
    """docs with the text less its repeated chunks (with passages: less all repeated runs of lines with `long` words, too), n_lines (before) and n_removed.

    few: the least words of a chunk of several lines. long: those of a passage, which goes wherever it stands; a repeated run of fewer, but not
    below few, goes where rolling hashes happen to bound it or a part of it, and stays otherwise. With passages and long = few nothing hangs on chance.
    """
    ready(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    columns, whole = docs.columns, docs
    # the caller's further columns stand in one, so that no name of theirs meets one of ours
    docs = whole.select("doc_id", "text", F.struct(*[c for c in columns if c != "text"]).alias("row"))
    plain = T.StructType([T.StructField("hash", T.LongType())])
    full = T.StructType([T.StructField("hash", T.LongType()), T.StructField("chunk", T.StringType()), T.StructField("doc_id", whole.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    arrow = to_arrow_schema(full)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, limits in blocks(batches):
            c = chunks(data, limits, passages, long)
            yield pa.RecordBatch.from_arrays([pa.array(c["hash"][_eligible(c, long, few)])], names=["hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            c = chunks(data, limits, passages, long)
            e = _eligible(c, long, few)
            e = e[likely(c["hash"][e])]
            text = data.tobytes()
            own = pa.array(c["row"][e])
            yield pa.RecordBatch.from_arrays([pa.array(c["hash"][e]), pa.array([text[a:b].decode() for a, b in zip(c["begin"][e].tolist(), c["end"][e].tolist(), strict=True)], pa.string()), batch.column("doc_id").take(own), batch.column("text_hash").take(own), pa.array(c["first"][e]), pa.array(c["last"][e])], schema=arrow)

    repeated = settle(docs.select("text").mapInArrow(hashed, plain).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "repeated")
    likely = _likely(repeated)
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = settle(keyed.select("doc_id", "text", "text_hash").mapInArrow(cut, full).withColumn("check", F.xxhash64("chunk")), "chunks")
    # grouping by the chunk itself compares bytes; copies meet in each task before they are shuffled
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"), F.col("first"))
    texts = found.groupBy("hash", "check", "chunk").agg(F.min(at).alias("keep"), F.count("*").alias("n"))
    kept = settle(texts.groupBy("hash", "check").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("keep").alias("keep")).filter("texts = 1 AND n > 1").select("hash", "check", "keep"), "kept")
    # a copy that overlaps what stays is cut beyond it
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))
    start = F.when(same, F.greatest("first", F.col("keep.first") + F.col("last") - F.col("first") + 1)).otherwise(F.col("first"))
    cuts = found.select("hash", "check", "doc_id", "text_hash", "first", "last").join(kept, ["hash", "check"]).filter(at != F.col("keep")).select(F.struct("doc_id", "text_hash").alias("who"), F.sequence(start, F.col("last")).alias("lines"))
    gone = settle(cuts.groupBy("who").agg(F.flatten(F.collect_set("lines")).alias("gone")).select(F.col("who.doc_id").alias("_id"), F.col("who.text_hash").alias("_hash"), "gone"), "gone")
    touched = among(gone, "_id", "_hash")
    keyed = keyed.withColumn("n_lines", F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long"))
    marked = keyed.withColumn("_touched", touched("doc_id", "text_hash"))
    intact = marked.filter("NOT _touched").withColumn("gone", F.lit(None).cast("array<bigint>"))
    altered = marked.filter("_touched").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, gone, strict=True):
            lost = set() if g is None else set(g.tolist())
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost) if lost else t)
        return pd.Series(out)

    both = intact.unionByName(altered.withColumn("text", without("text", "gone"))).drop("_touched", "text_hash")
    out = both.withColumn("n_removed", F.coalesce(F.size(F.array_distinct("gone")), F.lit(0)).cast("long"))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns], *ADDED)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, passages=True).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
