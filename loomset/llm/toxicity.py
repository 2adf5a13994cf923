"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the examples, a sample of labelled rows of bounded number and bytes; their document frequencies are counted over all
documents. A word weighs (1 + ln times) * idf * relevance: relevance frequency, log2(2 + its share of toxic examples over its share of
others), keeps every word at 1 or more and lifts those that toxic examples favour; relevance=False leaves plain TF-IDF. Examples stand in
blocks; a posting list is cut into cells, one for each block, with their maxima. A text's cosine with any example of a block is at most the sum
of its weights times those maxima (of frequent words, the largest exact part), so a text skips all blocks whose bound is below its k-th best example so far, and the most promising blocks
come first: the k nearest are exact. They vote with weights that fall with distance; a curve fitted on the examples, each left out in turn
(its own label counts nothing in its weights either), makes the vote a probability.

Defined cases: null and empty texts, and texts without a word of the examples, have no neighbours and get the share of label 1 among such
examples; words that no example has leave a text's ranking as it is and don't count; without labelled rows of both labels, every score is the
share of label 1 (0 if there are none); of equally near examples those with the smaller digest of their text and the smaller label come first,
so ids, which are whole numbers of any type, don't enter a score; whole texts of any length count; repeated rows score alike; carried columns
with the names of results give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomset.llm import labelled
from loomset.llm.common import blocks, part, ready, rows_of, words

#: About so many labelled rows, as many of either label, are examples, at any size of input.
MAX_EXAMPLES = 4096
#: About so many bytes of text all examples have: fewer of them where they are long.
MAX_BYTES = 32_000_000
BLOCK = 128
#: Terms that one in so many examples has are stored densely in each block.
DENSE = 16
#: Parts of the vocabulary whose document frequencies are summed apart.
SLICES = 64
K = 15
ADDED = ("score", "predicted", "evidence")


def _terms(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of all distinct words, sorted."""
    _, _, h, first = words(data, limits)
    row = rows_of(first)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, int)
    return row[new], h[new], np.diff(np.append(new, len(h)))


def counted(vocabulary: np.ndarray, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the vocabulary's terms, sorted. vocabulary: sorted hashes."""
    row, h, times = _terms(data, limits)
    at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
    hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
    return row[hit], at[hit], times[hit]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def unit(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The weights with every row's length made 1."""
    return weight / np.maximum(np.sqrt(np.bincount(row, weight**2, n)), 1e-12)[row]


class Index:
    """Examples' unit vectors in blocks: posting lists cut into cells of one term and block, with maxima. Of equally near examples the earlier given come first.

    Frequent terms, whose cells would fill every block, are a dense matrix instead: their part of a cosine is computed for all examples.
    """

    def __init__(self, ids: np.ndarray, y: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> None:
        weight = unit(row, weight, len(ids))
        order = np.lexsort((-weight, row))
        lead = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
        strongest = np.full(len(ids), terms)
        strongest[row[lead]] = term[lead]
        keep = np.unique(row)
        keep = keep[np.lexsort((keep, y[keep], strongest[keep]))]  # alike examples share blocks, so bounds are tight
        self.ids, self.y, self.given, self.n_blocks = ids[keep], y[keep], keep, -(-len(keep) // BLOCK)
        place = np.zeros(len(ids), np.int64)
        place[keep] = np.arange(len(keep))
        at = place[row]
        order = np.lexsort((at, term))
        at, term, weight = at[order], term[order], weight[order]
        cell = term * max(1, self.n_blocks) + at // BLOCK
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        self.at, self.weight, self.cell_start, self.cell_size = at % BLOCK, weight, new, np.diff(np.append(new, len(cell)))
        self.cell_block = at[new] // BLOCK
        self.cell_max = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)
        self.first_cell = np.searchsorted(term[new], np.arange(terms + 1))
        frequent = np.flatnonzero(np.bincount(term, minlength=terms) * DENSE > len(keep))
        self.slot = np.full(terms, -1)
        self.slot[frequent] = np.arange(len(frequent))
        dense = self.slot[term] >= 0
        self.dense = np.zeros((len(frequent), len(keep)))
        self.dense[self.slot[term[dense]], at[dense]] = weight[dense]

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Cosines and places of the k nearest examples of each of n unit rows, given by their entries (cosine 0: none), and the number of (row, block) pairs scored. skip: a place to leave out for each row.

        A cosine, to 12 digits, and the example's place among those given make one whole number, so that a partial sort settles ties too.
        """
        tail = np.int64(max(1, len(self.ids)).bit_length())
        best, scored = np.zeros((n, k), np.int64), 0
        by_given = np.argsort(self.given)
        order = np.empty(len(by_given), np.int64)
        order[by_given] = len(by_given) - np.arange(len(by_given))
        slots = self.slot[term]
        common = slots >= 0
        q = np.zeros((n, len(self.dense)))
        q[row[common], slots[common]] = weight[common]
        frequent = q @ self.dense
        row, term, weight = row[~common], term[~common], weight[~common]
        # rarer terms: the cells of every entry, by block; their maxima bound what they add to the frequent terms' part
        sizes = self.first_cell[term + 1] - self.first_cell[term]
        cell, entry = _ranges(self.first_cell[term], sizes), np.repeat(np.arange(len(term)), sizes)
        block = self.cell_block[cell]
        bound = np.zeros((n, self.n_blocks))
        if self.n_blocks:
            bound = np.bincount(row[entry] * self.n_blocks + block, weight[entry] * self.cell_max[cell], n * self.n_blocks).reshape(n, self.n_blocks)
            bound = bound + np.maximum.reduceat(frequent, np.arange(0, len(self.ids), BLOCK), axis=1)
        by_block = np.argsort(block.astype(np.int16 if self.n_blocks < 1 << 15 else np.int64), kind="stable")
        cell, entry = cell[by_block], entry[by_block]
        limits = np.searchsorted(block[by_block], np.arange(self.n_blocks + 1))
        for b in np.argsort(-bound.sum(0), kind="stable"):
            rows = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] >= (best[:, 0] >> tail) * 1e-12 - 1e-9))
            if not len(rows):
                continue
            scored += len(rows)
            here = slice(b * BLOCK, min((b + 1) * BLOCK, len(self.ids)))
            width = here.stop - here.start
            cosine = frequent[rows, here]
            local = np.full(n, -1)
            local[rows] = np.arange(len(rows))
            c, e = cell[limits[b] : limits[b + 1]], entry[limits[b] : limits[b + 1]]
            wanted = local[row[e]] >= 0
            c, e = c[wanted], e[wanted]
            posting, e = _ranges(self.cell_start[c], self.cell_size[c]), np.repeat(e, self.cell_size[c])
            cosine += np.bincount(local[row[e]] * width + self.at[posting], weight[e] * self.weight[posting], len(rows) * width).reshape(len(rows), width)
            key = np.where(cosine > 1e-12, (np.rint(cosine * 1e12).astype(np.int64) << tail) + order[here], 0)
            if skip is not None:
                key[np.arange(here.start, here.stop)[None, :] == skip[rows][:, None]] = 0
            best[rows] = np.partition(np.concatenate([best[rows], key], 1), -k, axis=1)[:, -k:]
        best = -np.sort(-best, axis=1)
        place = np.where(best > 0, by_given[len(by_given) - np.maximum(1, best & ((np.int64(1) << tail) - 1))] if len(by_given) else -1, -1)
        return np.where(best > 0, (best >> tail) * 1e-12, 0), place, scored


def relevance(ones: np.ndarray, others: np.ndarray, n_ones: int, n_others: int) -> np.ndarray:
    """Relevance frequency of terms that `ones` of n_ones toxic examples have and `others` of n_others others: 1 for a term that no toxic one has."""
    return np.log2(2 + ones / np.maximum(1, others) * (n_others / max(1, n_ones)))


class Model:
    """vocabulary (sorted hashes), factor of each term, index, prior of texts without neighbours, and the calibration curve (knots, values)."""

    def entries(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        row, term, times = counted(self.vocabulary, data, limits)
        n = len(limits) - 1
        return row, term, unit(row, (1 + np.log(times)) * self.factor[term], n), n

    def vote(self, cosine: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each weighing 1 / (distance + 0.05) and its label's true share over its share in the sample. -1: no neighbour."""
        near = place >= 0
        y = np.where(near, self.index.y[place], 0) if len(self.index.y) else np.zeros_like(cosine)
        weight = np.where(near, 1 / (1.05 - cosine) * np.where(y == 1, self.weigh[1], self.weigh[0]), 0)
        return np.where(near.any(1), (weight * y).sum(1) / np.maximum(weight.sum(1), 1e-12), -1)

    def probability(self, vote: np.ndarray) -> np.ndarray:
        return np.where(vote < 0, self.prior, np.interp(vote, *self.curve) if len(self.curve[0]) else self.prior)


def _curve(vote: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the vote by pooling neighbours that fall."""
    order = np.argsort(vote, kind="stable")
    pools: list[list[float]] = []
    for x, v, w in zip(vote[order], y[order], weight[order], strict=True):
        pools.append([x * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of all documents, and of those that have each term: packed counts of each task, summed by slices of the vocabulary on the executors."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("n", T.BinaryType())])
    cuts = np.linspace(0, len(vocabulary) + 1, SLICES + 1).astype(int)

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value) + 1, np.int64)  # the last: rows
        for _, data, limits in blocks(batches):
            seen[:-1] += np.bincount(counted(shared.value, data, limits)[1], minlength=len(shared.value))
            seen[-1] += len(limits) - 1
        yield packed({i: seen[a:b] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if seen[a:b].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("slice").to_pylist(), batch.column("n"), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(v.as_py(), np.int64)
        yield packed(sums)

    total = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():
        total[cuts[r["slice"]] : cuts[r["slice"] + 1]] = np.frombuffer(r["n"], np.int64)
    return int(total[-1]), total[:-1]


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 4, held: int = 2, most: int = MAX_EXAMPLES, most_bytes: int = MAX_BYTES, k: int = K, by_relevance: bool = True) -> Model:
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")  # ids of any whole-number type
    rows, counts = labelled.sample(docs, labels, column, modulus, held, most, balanced=True)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(1 << 30)) < int(most_bytes / size * (1 << 30)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("term", T.LongType()), T.StructField("times", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            row, h, times = _terms(data, limits)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("doc_id"))[row]), pa.array(h.view(np.int64)), pa.array(times)], names=schema.names)

    digests = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.xxhash64("text")).alias("digest")).collect()
    everyone = sorted((r["digest"], r["label"], r["doc_id"]) for r in digests)
    ids, y = np.array([r[2] for r in everyone], np.int64), np.array([r[1] for r in everyone], np.int64)
    total, positive = len(y), int(y.sum())
    m = Model()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    m.weigh = (0.0, 1.0) if positive == total else ((1 - share) / (1 - positive / total), share / (positive / total)) if positive else (1.0, 1.0)
    m.vocabulary, m.factor, m.prior, m.curve = np.zeros(0, np.uint64), np.zeros(0), share, (np.zeros(0), np.zeros(0))
    m.index = Index(*[np.zeros(0, int)] * 4, np.zeros(0), 0)
    if not 0 < positive < total:
        return m
    got = rows.select("doc_id", "text").mapInArrow(extract, schema).groupBy("doc_id", "term").agg(F.max("times").alias("times")).toArrow()
    by_id = np.argsort(ids)
    row, times = by_id[np.searchsorted(ids[by_id], np.asarray(got.column("doc_id")))], np.asarray(got.column("times"))
    m.vocabulary, term = np.unique(np.asarray(got.column("term")).view(np.uint64), return_inverse=True)
    n_docs, df = document_frequencies(docs, m.vocabulary)
    idf = 1 + np.log((1 + n_docs) / (1 + df))
    ones = np.bincount(term, y[row], len(idf))
    others = np.bincount(term, 1 - y[row], len(idf))
    m.factor = idf * (relevance(ones, others, positive, total - positive) if by_relevance else 1)
    m.index = Index(ids, y, row, term, (1 + np.log(times)) * m.factor[term], len(idf))
    # calibration: each example without itself, in the index and in its own weights
    own = y[row]
    weight = (1 + np.log(times)) * idf[term] * (relevance(ones[term] - own, others[term] - (1 - own), positive, total - positive) if by_relevance else 1)
    weight = unit(row, weight, total)
    order = np.argsort(row, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    places = np.full(total, -1)
    places[m.index.given] = np.arange(len(m.index.ids))
    vote = np.full(total, -1.0)
    for i in range(0, total, 256):
        j, (a, b) = min(total, i + 256), np.searchsorted(row, (i, i + 256))
        vote[i:j] = m.vote(*m.index.nearest(row[a:b] - i, term[a:b], weight[a:b], j - i, k, places[i:j])[:2])
    weight = np.where(y == 1, m.weigh[1], m.weigh[0])
    lone = vote < 0
    if lone.any():
        m.prior = float((y * weight)[lone].sum() / weight[lone].sum())
    if not lone.all():
        m.curve = _curve(vote[~lone], y[~lone].astype(float), weight[~lone])
    return m


def classify(docs: DataFrame, model: Model, carry: list[str], threshold: float = 0.3, k: int = K) -> DataFrame:
    """The carried columns with score, predicted and evidence: the nearest examples with label and similarity."""
    spark = ready(docs.sparkSession)
    carry = [c for c in carry if c.lower() not in ADDED]
    shared = spark.sparkContext.broadcast(model)
    proof = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", proof)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, limits in blocks(batches, rows=512):
            cosine, place, _ = m.index.nearest(*m.entries(data, limits), k)
            p = np.round(m.probability(m.vote(cosine, place)), 6)
            kept = place >= 0
            flat = place[kept]
            structs = pa.StructArray.from_arrays([pa.array(m.index.ids[flat].astype(np.int64)), pa.array(m.index.y[flat].astype(np.int32)), pa.array(np.round(cosine[kept], 6))], names=["doc_id", "label", "similarity"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]).astype(np.int32)), structs).cast(arrow.field("evidence").type)
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in carry] + [pa.array(p), pa.array((p >= threshold).astype(np.int32)), lists], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classify(docs, model, ["doc_id"])
    return scored.select("doc_id", (part("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.transform("evidence", lambda e: e.doc_id).alias("evidence"))
