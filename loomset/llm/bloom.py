"""A filter of bounded size for "maybe among these keys", made by Spark and checked in Arrow batches.

It only spares shuffles: what it lets through is always checked exactly afterwards, so results don't depend on its size. Beyond MOST_BITS it lets
more rows through, and at worst all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import ready

#: 16 MB to each executor, at most.
MOST_BITS = 1 << 27
PROBES = 4


def among(keys: DataFrame, *columns: str, most_bits: int = MOST_BITS) -> Callable[..., Column]:
    """A function of the same number of columns that is true for all keys, and false for most others."""
    spark = ready(keys.sparkSession)
    bits = min(most_bits, 1 << max(16, int(np.ceil(np.log2(16 * max(1, keys.count()))))))
    spot = [F.pmod(F.xxhash64(F.lit(p), *columns), F.lit(bits)) for p in range(PROBES)]
    words = keys.select(F.explode(F.array(*spot)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[np.asarray(words.column("w"))] = np.asarray(words.column("mask"))
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for x in (a, b, c, d):
            x = x.to_numpy()
            out &= (shared.value[x >> 6] >> (x & 63)) & 1 == 1
        return pd.Series(out)

    return lambda *at: maybe(*[F.pmod(F.xxhash64(F.lit(p), *at), F.lit(bits)) for p in range(PROBES)])
