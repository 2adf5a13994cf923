"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words. For each pattern length m a shift table over blocks of two words tells how far a search window may move on; where it may
not move, the bucket of patterns with the same last block (and then the same first block) is compared word by word. Cursors over many stretches
of many documents move together, as arrays.

Defined cases: null and word-less texts have no words and no hits; items without words have no windows; a null item_id is the item `null`;
repeated rows give repeated results; an empty benchmark hits nothing; further columns are carried where asked for, but for those with the names of
results, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomset.llm.common import blocks, mix, ready, settle, words

#: Bytes of benchmark text searched for in one pass over the documents, about; a larger benchmark is searched for in several passes.
PATTERN_BYTES = 16_000_000
#: End positions that a cursor covers; a long text has many cursors.
STRETCH = 256
#: Slots of a shift table for each block, and the most slots: 32 MB.
_SLOTS = 8
_MOST_BITS = 24
ADDED = ("n_words", "spans", "items")


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b, 5)


class Patterns:
    """Windows of items' words, by length, with shift tables and suffix buckets."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            data = np.frombuffer(text, np.uint8)
            starts, ends, _, _ = words(data, np.array([0, len(text)]))
            own = [text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(name)
        self.by_length = {}
        for m in sorted({len(x) for x in found}):
            texts = [x for x in found if len(x) == m]
            flat = b" ".join(w for x in texts for w in x)
            data = np.frombuffer(flat, np.uint8)
            _, _, h, _ = words(data, np.array([0, len(flat)]))
            h = h.reshape(len(texts), m)
            block = h if m == 1 else _join(h[:, :-1], h[:, 1:])
            bits = min(_MOST_BITS, max(16, (_SLOTS * block.size).bit_length()))
            shift = np.full(1 << bits, m if m == 1 else m - 1, np.int16)
            for q in range(block.shape[1]):
                np.minimum.at(shift, (block[:, q] & np.uint64(len(shift) - 1)).astype(np.int64), block.shape[1] - 1 - q)
            order = np.argsort(block[:, -1], kind="stable")
            self.by_length[m] = (shift, block[order, -1], block[order, 0], [b" ".join(texts[i]) for i in order], [sorted(found[texts[i]]) for i in order])

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, end, items) of all occurrences; words are numbered over all rows."""
        for m, (shift, last, head, texts, items) in self.by_length.items():
            at, stop = _cursors(first, m)
            candidates = []
            while len(at):
                step = shift[(_block(h, at, m) & np.uint64(len(shift) - 1)).astype(np.int64)]
                candidates.append(at[step == 0])
                at = at + np.maximum(step, 1)
                keep = at < stop
                at, stop = at[keep], stop[keep]
            if not candidates:
                continue
            at = np.concatenate(candidates)
            suffix = _block(h, at, m)
            lo, hi = np.searchsorted(last, suffix, "left"), np.searchsorted(last, suffix, "right")
            some = hi > lo
            at, lo, n = at[some], lo[some], (hi - lo)[some]
            pattern = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            same = head[pattern] == _block(h, at - m + min(m, 2), m)
            for p, e in zip(pattern[same].tolist(), at[same].tolist(), strict=True):
                if b" ".join(data[starts[i] : ends[i]].tobytes().lower() for i in range(e - m + 1, e + 1)) == texts[p]:
                    yield e - m + 1, e + 1, items[p]


def _block(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    return h[at] if m == 1 else _join(h[at - 1], h[at])


def _cursors(first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop positions of window ends, a pair for each stretch of each row."""
    begin, end = first[:-1] + m - 1, first[1:]
    n = np.maximum(0, -(-(end - begin) // STRETCH))
    start = np.repeat(begin, n) + STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(start + STRETCH, np.repeat(end, n))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _merged(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _pass(docs: DataFrame, items: list[tuple[str, bytes]], window: int, carry: list[str]) -> DataFrame:
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Patterns(items, window))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)
    again = "spans" in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch, data, limits in blocks(batches):
            starts, ends, h, first = words(data, limits)
            n = len(limits) - 1
            found, names = ([[] for _ in range(n)], [set() for _ in range(n)]) if not again else ([[(x["start"], x["end"]) for x in r] for r in batch.column("spans").to_pylist()], [set(r) for r in batch.column("items").to_pylist()])
            for a, b, its in patterns.search(data, starts, ends, h, first):
                r = int(np.searchsorted(first, a, "right")) - 1
                found[r].append((a - int(first[r]), b - int(first[r])))
                names[r].update(its)
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in carry] + [pa.array(np.diff(first), pa.int64()), pa.array([_merged(x) if x else [] for x in found], arrow.field("spans").type), pa.array([sorted(x) for x in names], arrow.field("items").type)], schema=arrow)

    used = list(dict.fromkeys([*carry, "text", *(["spans", "items"] if again else [])]))
    return docs.select(*used).mapInArrow(scan, schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The carried columns of docs (all, if None) with n_words, spans (hit stretches of words) and items (ids as strings, sorted)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    carry = docs.columns if carry is None else carry
    known = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text")).filter("text IS NOT NULL")
    passes = max(1, -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pattern_bytes))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for k in range(passes):  # the driver holds one group of items at a time, dealt by hash
        items = [(r["item_id"], r["text"].encode()) for r in (known if passes == 1 else known.filter(group == k)).collect()]
        final = k == passes - 1
        docs = _pass(docs, items, window, carry if final or "text" in carry else [*carry, "text"])
        if not final:  # the next pass needs the room of this one's patterns
            docs = settle(docs, "decontaminate")
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(p) WHERE len(w) > 0
), dw AS (
  SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM iw), unnest(range(1, len(w) - m + 2)) AS t(p)
), h AS (
  SELECT r, p, m, item_id FROM dw JOIN iw USING (m, s)
), n AS (
  SELECT r, count(DISTINCT p + k)::BIGINT AS n_hit FROM h, unnest(range(0, m)) AS t(k) GROUP BY r
), x AS (
  SELECT r, count(*)::BIGINT AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)
"""
