"""A Spark data source for safetensors files: ranges of rows of chosen tensors, and a parallel, transactional writer.

Reading: the header alone decides the tasks. `read` takes a filter over the header (key, dtype, shape, ord), which Spark runs over header rows, so
what it drops is never read; a tensor larger than a chunk comes as several rows of whole matrix rows, so none is limited by the size of a Spark row.
The source doesn't take pushed filters: Spark 4.1 keeps those with the relation, so that two filters of one frame would both get the later one's rows.

Writing: the header's layout is fixed first, so every task writes its bytes at their final places in a file beside the target, in any order. Each task
reports the ranges that it wrote; the commit checks that they tile the file without gap or overlap, writes the header last, and moves the file into
place. A task that runs again writes the same bytes to the same places; a failed job leaves nothing behind, and an older file of that name stays
until the commit. The file system must be open to all executors under one path and allow writes at an offset (local, NFS, FUSE mounts).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomset.sources.tensorlayout import PADDING, SIZES, header
from loomset.storage import importable

SCHEMA = "key string, dtype string, shape array<bigint>, ord bigint, row bigint, rows bigint, begin bigint, end bigint, data binary"
CHUNK, PARTITION = 64 << 20, 128 << 20

def tensors_of(path: str) -> list[tuple]:
    """(key, dtype, shape, ord, begin, end) in order of place, from the header."""
    tree, start, _ = header(path)
    found = sorted(((k, x) for k, x in tree.items() if k != "__metadata__"), key=lambda t: (t[1]["data_offsets"], t[0]))
    return [(k, x["dtype"], x["shape"], i, start + x["data_offsets"][0], start + x["data_offsets"][1]) for i, (k, x) in enumerate(found)]


def chunks(tensor: tuple, most: int) -> Iterator[tuple]:
    """(key, dtype, shape, ord, row, rows, begin, end): ranges of whole rows of the first dimension of about `most` bytes; a row is never cut."""
    key, dtype, shape, ord_, begin, end = tensor
    n = shape[0] if shape else 1
    each = (end - begin) // n if n else 0
    step = max(1, most // each) if each else max(1, n)
    for row in range(0, max(n, 1), step):
        rows = min(step, n - row)
        yield key, dtype, shape, ord_, row, rows, begin + row * each, begin + (row + rows) * each


@dataclass
class Ranges(InputPartition):
    chunks: list[tuple]


class TensorReader(DataSourceReader):
    """Options: path; tensors, a JSON list of the ords to read (all, if there's none); chunkbytes; partitionbytes."""

    def __init__(self, options: dict[str, str]):
        self.path, self.tensors = options["path"], json.loads(options.get("tensors", "null"))
        self.chunk, self.partition = int(options.get("chunkbytes", CHUNK)), int(options.get("partitionbytes", PARTITION))

    def partitions(self) -> Sequence[InputPartition]:
        out, held, wanted = [Ranges([])], 0, self.tensors if self.tensors is None else set(self.tensors)
        for t in tensors_of(self.path):
            if wanted is None or t[3] in wanted:
                for c in chunks(t, self.chunk):
                    if held and held + c[7] - c[6] > self.partition:
                        out.append(Ranges([]))
                        held = 0
                    out[-1].chunks.append(c)
                    held += c[7] - c[6]
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.binary())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        with open(self.path, "rb") as f:
            for c in partition.chunks:
                data = fetch(f, c[6], c[7] - c[6])
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*c, data), kinds, strict=True)], names)


def fetch(f, begin: int, size: int) -> bytes:
    f.seek(begin)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"{f.name}: ends before byte {begin + size}")
    return data


# --- writing ---


@dataclass
class Written(WriterCommitMessage):
    ranges: list[tuple[int, int]] = field(default_factory=list)


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, those that meet joined; those that overlap stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class TensorWriter(DataSourceArrowWriter):
    """Rows (key, at, data): data goes to byte `at` of the tensor."""

    def __init__(self, options: dict[str, str]):
        self.layout = options["layout"]

    def _plan(self) -> dict:
        with open(self.layout, encoding="utf-8") as f:
            return json.load(f)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        plan, ranges = self._plan(), []
        places = plan["tensors"]
        with open(plan["tmp"], "r+b") as out:
            for batch in iterator:
                for key, at, data in zip(*(batch.column(c) for c in ("key", "at", "data")), strict=True):
                    key, at, data = key.as_py(), at.as_py(), data.as_buffer()
                    if key not in places:
                        raise ValueError(f"{key}: not planned")
                    begin, end = places[key]
                    if at < 0 or begin + at + data.size > end:
                        raise ValueError(f"{key}: not as planned")
                    out.seek(begin + at)
                    out.write(data)
                    ranges.append((begin + at, begin + at + data.size))
            out.flush()
            os.fsync(out.fileno())
        return Written(merged(r for r in ranges if r[0] < r[1]))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        plan, at = self._plan(), None
        for a, b in merged(r for m in messages if m for r in m.ranges):
            if a != (plan["start"] if at is None else at):
                raise ValueError(f"the tensors don't tile the file at byte {a}")
            at = b
        if (plan["start"] if at is None else at) != plan["end"]:
            raise ValueError(f"tensors are missing from byte {at} on")
        with open(plan["tmp"], "r+b") as out:
            out.write(plan["head"].encode("latin-1"))
            out.flush()
            os.fsync(out.fileno())
        os.replace(plan["tmp"], plan["path"])
        os.remove(self.layout)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.layout):
            tmp = self._plan()["tmp"]
            for f in (tmp, self.layout):
                if os.path.exists(f):
                    os.remove(f)


class TensorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    importable(spark)
    spark.dataSource.register(TensorFile)
    return spark


def read(spark: SparkSession, path: str, keys: Column | None = None, chunk_bytes: int = CHUNK, partition_bytes: int = PARTITION) -> DataFrame:
    """SCHEMA of the tensors that `keys`, a filter over the header's rows, takes."""
    from loomset.sources.safetensors import scan

    source = register(spark).read.format("tensorfile").option("chunkbytes", chunk_bytes).option("partitionbytes", partition_bytes)
    if keys is not None:
        source = source.option("tensors", json.dumps([r["ord"] for r in scan(spark, path).filter(keys).select("ord").collect()]))
    return source.load(path)


def layout(plan: list[tuple], extra: dict[str, str] | None = None) -> tuple[str, int, dict[str, tuple[int, int]], int]:
    """plan: (key, dtype, shape), in order -> (header text, padded; where data begin; each tensor's place; where data end)."""
    tree: dict = {"__metadata__": {k: str(v) for k, v in extra.items()}} if extra else {}
    at, places = 0, {}
    for key, dtype, shape in plan:
        size = SIZES[dtype]
        for n in shape:
            size *= n
        if key in tree:
            raise ValueError(f"{key}: twice")
        tree[key] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + size]}
        places[key] = (at, at + size)
        at += size
    head = json.dumps(tree, separators=(",", ":"), sort_keys=True)
    head += " " * (-(8 + len(head)) % PADDING)
    start = 8 + len(head)
    return head, start, {k: (start + a, start + b) for k, (a, b) in places.items()}, start + at


def write(rows: DataFrame, path: str, plan: list[tuple], extra: dict[str, str] | None = None) -> None:
    """One file from rows (key, at, data), in any order and partition; plan: (key, dtype, shape) in the file's order. The header alone is on the driver."""
    head, _, places, end = layout(plan, extra)
    put(rows, path, struct.pack("<Q", len(head)) + head.encode(), places, end)


def put(rows: DataFrame, path: str, head: bytes, places: dict[str, tuple[int, int]], end: int) -> None:
    """One file of `end` bytes: head, and rows (key, at, data) at their places, which must tile what follows the head."""
    mark = uuid.uuid4().hex
    tmp, side = f"{path}.{mark}.tmp", f"{path}.{mark}.layout"
    with open(tmp, "wb") as out:
        out.truncate(end)
    with open(side, "w", encoding="utf-8") as out:
        json.dump({"path": path, "tmp": tmp, "head": head.decode("latin-1"), "start": len(head), "end": end, "tensors": places}, out)
    try:
        register(rows.sparkSession)
        rows.select("key", F.col("at").cast("long").alias("at"), "data").write.format("tensorfile").mode("append").option("layout", side).save()
    finally:
        for f in (tmp, side):
            if os.path.exists(f):
                os.remove(f)
