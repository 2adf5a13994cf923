"""Safetensors checkpoints: tensors as rows, and back.

The header is read first; then executors read and write tensors' bytes by offset (tensorfile), so no file passes through one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.sources.tensorlayout import PADDING, SIZES, header  # noqa: F401
from loomset.storage import importable

#: numpy types of the float types that it has.
_NUMPY = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}


def metadata(path: str) -> dict[str, str]:
    return header(path)[0].get("__metadata__", {})


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(key, dtype, shape, begin, end, ord), ord by place in the file: from the header alone."""
    tree, start, _ = header(path)
    rows = sorted(((k, x["dtype"], x["shape"], start + x["data_offsets"][0], start + x["data_offsets"][1]) for k, x in tree.items() if k != "__metadata__"), key=lambda r: (r[3], r[0]))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, dtype string, shape array<bigint>, begin bigint, end bigint, ord bigint")


def read(spark: SparkSession, path: str, keys: Column | None = None, chunk_bytes: int | None = None) -> DataFrame:
    """scan with row, rows and data; tensors that `keys`, a filter over scan's rows, doesn't take aren't read. The path must be open to all executors.

    A tensor of more than chunk_bytes comes as several rows, `rows` of its rows from `row` on.
    """
    from loomset.sources import tensorfile

    return tensorfile.read(spark, path, keys, chunk_bytes or tensorfile.CHUNK)


def decode(data: bytes, dtype: str) -> np.ndarray:
    """Floats of 32 bits; those of 64 are narrowed."""
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4")
    return np.frombuffer(data, _NUMPY[dtype]).astype("<f4")


def encode(values: np.ndarray, dtype: str) -> bytes:
    """Rounded to nearest, ties to even."""
    v = np.asarray(values, "<f4")
    if dtype == "BF16":
        u = v.view("<u4")
        rounded = ((u + 0x7FFF + ((u >> 16) & 1)) >> 16).astype("<u2")
        return np.where(np.isnan(v), (u >> 16).astype("<u2") | 0x40, rounded).astype("<u2").tobytes()
    with np.errstate(over="ignore"):
        return v.astype(_NUMPY[dtype]).tobytes()


def decoded(tensors: DataFrame) -> DataFrame:
    """With values (null for types that aren't computed with)."""

    @F.pandas_udf("array<float>")
    def values(data: pd.Series, dtype: pd.Series) -> pd.Series:
        return pd.Series([decode(d, t) if t in (*_NUMPY, "BF16") else None for d, t in zip(data, dtype, strict=True)], dtype=object)

    importable(tensors.sparkSession)
    return tensors.withColumn("values", values("data", "dtype"))


def encoded(tensors: DataFrame, dtype: Column) -> DataFrame:
    """With data made from values, in the given type."""

    @F.pandas_udf("binary")
    def data(values: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([encode(v, t) for v, t in zip(values, kind, strict=True)], dtype=object)

    importable(tensors.sparkSession)
    return tensors.withColumn("dtype", dtype).withColumn("data", data("values", "dtype"))


def write(tensors: DataFrame, path: str, extra: dict[str, str] | None = None) -> None:
    """One file, as the format wants, of rows (ord, key, dtype, shape, data), or with `row`, of which data begins with that row of the tensor.

    Names, types and shapes make the header on the driver; executors write the bytes at their places (see tensorfile).
    """
    from loomset.sources import tensorfile

    plan = tensors.groupBy("key").agg(F.first("dtype").alias("dtype"), F.first("shape").alias("shape"), F.min("ord").alias("ord")).orderBy("ord", "key").collect()
    size = F.element_at(F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv]), F.col("dtype"))
    inner = F.aggregate(F.slice("shape", F.lit(2), F.greatest(F.size("shape") - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x)
    at = F.col("row") * size * inner if "row" in tensors.columns else F.lit(0)
    tensorfile.write(tensors.select("key", at.alias("at"), "data"), path, [(r["key"], r["dtype"], r["shape"]) for r in plan], extra)
