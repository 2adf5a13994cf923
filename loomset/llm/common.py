"""What the operators share: shared storage, word kernels over Arrow buffers, and input tidying."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that a task handles at once; a longer text is handled alone and whole.
BLOCK_BYTES = 500_000
BLOCK_ROWS = 2048
#: Python workers keep the buffers of a block for the next one, and give what is above that back to the system.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "16777216", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Rows and bytes of the batches that go to Python workers, unless the session says otherwise: rows hold whole texts here.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, where the cluster was not given it by --py-files, and bound their batches and allocators."""
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


#: Temporary folders of sessions that set none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomset-")
        place = _OWN[app]
    return place


#: Folders of the runs under way, innermost last.
_RUNS: ContextVar[tuple[str, ...]] = ContextVar("runs", default=())


def _place(spark: SparkSession, runs: tuple[str, ...]) -> str:
    return runs[-1] if runs else f"{shared_dir(spark).rstrip('/')}/loomset"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside go when the block ends well; those settled with keep belong to the block around it, or stay where there is none."""
    folder = f"{_place(spark, _RUNS.get())}/run-{uuid.uuid4().hex}"
    mark = _RUNS.set((*_RUNS.get(), folder))
    try:
        yield
    finally:
        _RUNS.reset(mark)
    _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written once as a table in the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_place(spark, _RUNS.get()[:-1] if keep else _RUNS.get())}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(settled: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more."""
    spark = settled.sparkSession
    jvm = spark.sparkContext._jvm
    for file in settled.inputFiles()[:1]:
        _delete(spark, jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus` (null ids: those of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# --- words of Arrow text columns, without a Python loop over rows or words ---


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits (n + 1) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, np.int64)[column.offset : column.offset + len(column) + 1] if limits and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[limits[0] : limits[-1]], limits - limits[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most `most` text bytes and `rows` rows, or of one row, with their bytes and row limits."""
    for batch in batches:
        data, limits = utf8(batch.column(text))
        i, n = 0, len(limits) - 1
        while i < n:
            j = max(i + 1, min(i + rows, int(np.searchsorted(limits, limits[i] + most, "right")) - 1))
            yield batch.slice(i, j - i), data[limits[i] : limits[j]], limits[i : j + 1] - limits[i]
            i = j


def spans(inside: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross rows: starts, ends, and the index of each row's first run (n + 1)."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[limits] = True
    apart = edge[1:n] | ~(inside[1:] & inside[:-1])
    left, right = inside.copy(), inside.copy()
    left[1:] &= apart
    right[:-1] &= apart
    starts = np.flatnonzero(left)
    return starts, np.flatnonzero(right) + 1, np.searchsorted(starts, limits)


def rows_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Word bytes: digits, letters and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True
_FOLDED = _BYTE[_FOLD]


def prefix(data: np.ndarray, fold: bool = True) -> np.ndarray:
    """Sums from which any span's hash follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * _powers(len(data))[0][: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * _powers(len(total))[1][starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z lower-cased if fold: the same for equal bytes wherever they stand."""
    return span_hashes(prefix(data, fold), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def words(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes of folded words, and the index of each row's first word."""
    starts, ends, first = spans(WORD[data], limits)
    return starts, ends, hashes(data, starts, ends), first


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within rows and the index of each row's first; a row of fewer words, but not none, has one of them all."""
    n, counts = len(word), np.diff(first)
    value = np.zeros(n, np.uint64)
    for j in range(k):
        value[: n - j] += word[j:] * np.uint64(2 * j + 3) * np.uint64(_BASE)
        value = mix(value, j) if j < k - 1 else value
    value = mix(value, k)
    owned = np.repeat(np.maximum(counts - k + 1, 0), counts)
    place = np.arange(n) - np.repeat(first[:-1], counts)
    keep = place < owned
    short = np.flatnonzero((counts > 0) & (counts < k))
    for r in short:
        at = first[r]
        keep[at] = True
        value[at] = mix(np.array([(int(word[at : first[r + 1]].astype(object).dot([pow(_BASE, j + 1, 1 << 64) for j in range(counts[r])])) + int(counts[r])) % (1 << 64)], np.uint64), 999)[0]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return value[keep], kept[first]
