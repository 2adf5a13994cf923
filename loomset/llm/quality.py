"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank, so that a row is scored in time linear in its features: half of the sum over factors of (sum v x)^2 - sum
(v x)^2. Fitted on the driver by Adam from a bounded sample of labelled rows; scored over all rows in numpy batches.

Defined cases: null and empty texts have no words and the structure of an empty text, and are scored; a null n_chars is a feature of its own;
without labelled rows of both labels, every score is the share of label 1 (1/2 if there are none); whole texts count; repeated rows score alike;
carried columns with the names of results give way.
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
from loomset.llm.common import SPACE, blocks, hashes, part, ready, spans

#: About so many labelled rows are fitted on, at any size of input.
MAX_EXAMPLES = 8192
#: Steps of the fit, about, at any number of examples.
STEPS = 256
BUCKETS = 1 << 16
RANK = 8
ADDED = ("score", "predicted")
STATS = 20
BINS = 10
SIZE = BUCKETS + STATS + STATS * BINS

_KIND = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "stop": b".,;:", "mark": b"!?", "bar": b"|", "symbol": b"#$%&*@^~_=+<>/\\{}[]()", "line": b"\n"}.items()}


def _stats(data: np.ndarray, limits: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray, noted: np.ndarray) -> np.ndarray:
    """Row x STATS, each 0 to 1. noted: n_chars as given, or -1."""
    n, size, count = len(limits) - 1, np.maximum(1, np.diff(limits)), np.diff(first)
    share = lambda kind: np.diff(np.concatenate([[0], np.cumsum(_KIND[kind][data])])[limits]) / size
    row = np.repeat(np.arange(n), count)
    mean = lambda x: np.bincount(row, x, n) / np.maximum(1, count)
    distinct = _distinct(row, h, n)
    lead, last = data[starts] if len(starts) else data[:0], data[ends - 1] if len(ends) else data[:0]
    lines = share("line") * size
    shouted = np.concatenate([[0], np.cumsum(_KIND["lower"][data])])
    return np.stack([
        np.log1p(size) / 16, np.log1p(count) / 14, mean(np.minimum(ends - starts, 40)) / 40, share("upper"), share("lower"), share("digit"), share("wide"), share("stop"), share("mark"), share("bar"),
        share("symbol"), np.log1p(lines) / 10, np.minimum(1, count / (lines + 1) / 100), distinct / np.maximum(1, count), mean(_KIND["symbol"][last]), mean(_KIND["mark"][last]), mean((shouted[ends] == shouted[starts]) & _KIND["upper"][lead]), mean((ends - starts) == 1),
        (noted < 0).astype(float), np.where(noted < 0, 0, np.minimum(1, np.abs(np.log1p(np.maximum(noted, 0)) - np.log1p(size)))),
    ], axis=1).clip(0, 1)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return np.bincount(r[new], minlength=n)


def features(batch: pa.RecordBatch, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices, values, and the index of each row's first (n + 1). Words' values have length 1 together."""
    n = len(limits) - 1
    starts, ends, first = spans(~SPACE[data], limits)
    h = hashes(data, starts, ends)
    row = np.repeat(np.arange(n), np.diff(first))
    key, times = np.unique(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    owner, value = key // BUCKETS, np.log1p(times)
    value = value / np.sqrt(np.bincount(owner, value**2, n))[owner]
    noted = np.asarray(batch.column("n_chars").fill_null(-1).cast(pa.float64()))
    stats = _stats(data, limits, starts, ends, first, h, noted)
    bins = BUCKETS + STATS + np.arange(STATS) * BINS + np.minimum(BINS - 1, (np.sqrt(stats) * BINS).astype(int))
    dense = np.concatenate([np.broadcast_to(BUCKETS + np.arange(STATS), (n, STATS)), bins], axis=1)
    index = np.concatenate([key % BUCKETS, dense.ravel()])
    values = np.concatenate([value, np.concatenate([stats, np.full((n, STATS), 0.3)], axis=1).ravel()])
    owner = np.concatenate([owner, np.repeat(np.arange(n), 2 * STATS)])
    order = np.argsort(owner, kind="stable")
    return index[order], values[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def score(model: tuple, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    bias, w, v = model
    if len(first) < 2:
        return np.zeros(0)
    linear = np.add.reduceat(w[index] * value, first[:-1])
    vx = v[index] * value[:, None]
    return bias + linear + 0.5 * (np.add.reduceat(vx, first[:-1]) ** 2 - np.add.reduceat(vx**2, first[:-1])).sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 256, rate: float = 0.01, decay: float = 1e-5) -> tuple:
    rng = np.random.default_rng(8)
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    model = [np.log(base / (1 - base)), np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)]
    if len(set(y.tolist())) < 2:
        return (model[0], model[1], np.zeros_like(model[2]))
    m, s, t = [0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32)], [0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32)], 0
    for _ in range(-(-steps // -(-len(y) // batch))):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            n = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            x, f, begin = index[at], value[at], np.concatenate([[0], np.cumsum(n)])
            slope = (_sigmoid(score(tuple(model), x, f, begin)) - y[rows]).astype(np.float32) / len(rows)
            own = np.repeat(slope, n) * f
            total = np.repeat(np.add.reduceat(model[2][x] * f[:, None], begin[:-1]), n, axis=0)
            by = np.argsort(x, kind="stable")
            used, start = np.unique(x[by], return_index=True)
            grads = [slope.sum(), np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32)]
            grads[1][used] = np.add.reduceat(own[by], start)
            grads[2][used] = np.add.reduceat((own[:, None] * (total - model[2][x] * f[:, None]))[by], start)
            t += 1
            for k in range(3):
                g = grads[k] + decay * model[k] * (k > 0)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model[k] = model[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(model)


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, held: int = 0, most: int = MAX_EXAMPLES) -> tuple:
    ready(docs.sparkSession)
    rows, _ = labelled.sample(docs.select("doc_id", "text", "n_chars"), labels, column, modulus, held, most, balanced=False)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            index, value, first = features(batch, data, limits)
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)).cast(arrow.field(c).type) for c, x in (("index", index.astype(np.int32)), ("value", value))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], schema=arrow)

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars", "label").mapInArrow(extract, schema).toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    lists = [got.column(c).combine_chunks() for c in ("index", "value")]
    index, value = (np.concatenate([np.asarray(c.flatten()) for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])] or [np.zeros(0)]) for x in lists)
    count = np.asarray(pa.compute.list_value_length(got.column("index"))) if len(got) else np.zeros(0, int)
    return fit(index.astype(np.int64), value.astype(np.float32), np.concatenate([[0], np.cumsum(count)]).astype(np.int64), np.asarray(got.column("label")).astype(np.float32))


def classify(docs: DataFrame, model: tuple, carry: list[str], threshold: float = 0.3) -> DataFrame:
    """The carried columns with score and predicted."""
    spark = ready(docs.sparkSession)
    carry = [c for c in carry if c.lower() not in ADDED]
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            p = np.round(_sigmoid(score(shared.value, *features(batch, data, limits))).astype(np.float64), 6)
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in carry] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, "text", "n_chars"])).mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model, ["doc_id"]).select("doc_id", (part("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
