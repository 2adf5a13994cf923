"""Language identification by hyperdimensional profiles.

Each letter, of any script, has a random vector of +1 and -1 of its own; a trigram's vector binds (multiplies) those of its letters, rotated by their places; texts and
languages bundle (add) the vectors of their trigrams; a text goes to the language whose prototype has the largest cosine.

Defined cases: a null text, or one without letters, is `und` with score 0; with nothing to learn from, all are `und`; ties go to the first
language by code point; repeated rows are scored alike; whole texts of any length count; a null lang is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomset.llm.common import blocks, mix, part, ready

DIMS = 1024
#: A trigram code holds three code points of so many bits; 0 stands for all that isn't a letter.
BITS = 21
#: A text's trigrams weigh this much together when languages are learned, so long texts don't outweigh short ones; one of more trigrams weighs their number.
TEXT_WEIGHT = 1_000_000


def _symbol(c: str) -> int:
    return ord(c.lower()[0]) if c.isalpha() else 0


@lru_cache(1)
def _table() -> np.ndarray:
    return np.array([_symbol(chr(i)) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], np.int64)


def letters(symbols: np.ndarray) -> np.ndarray:
    """Each symbol's vector of +1 and -1, drawn from its own code point."""
    places = np.arange(DIMS // 64, dtype=np.uint64)
    drawn = mix(mix(symbols.astype(np.uint64), 20)[:, None] + places * np.uint64(0x9E3779B97F4A7C15), 21)
    return (np.unpackbits(drawn.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def vectors(codes: np.ndarray) -> np.ndarray:
    """Trigrams' vectors: those of the letters, rotated by their places and multiplied."""
    out = np.ones((len(codes), DIMS), np.int8)
    for place in range(3):
        symbols, at = np.unique(codes >> BITS * (2 - place) & (1 << BITS) - 1, return_inverse=True)
        out *= np.roll(letters(symbols), 2 - place, axis=1)[at]
    return out.astype(np.float32)


def trigrams(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes with a letter in the middle, and the row of each. Non-letters count as one symbol, so trigrams don't join words or rows."""
    text = data.tobytes()
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    low = points < 0x10000
    s = _table()[np.where(low, points, 0)]
    if not low.all():
        far, at = np.unique(points[~low], return_inverse=True)
        s[~low] = np.array([_symbol(chr(i)) for i in far], np.int64)[at]
    # bytes that begin a code point, up to each row's limit
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[limits]
    before, after = np.zeros_like(s), np.zeros_like(s)
    before[1:], after[:-1] = s[:-1], s[1:]
    inner = heads[(heads > 0) & (heads < len(s))]
    before[inner] = 0
    after[inner - 1] = 0
    at = np.flatnonzero(s)
    codes = before[at] << 2 * BITS | s[at] << BITS | after[at]
    return codes, np.repeat(np.arange(len(limits) - 1), np.diff(np.searchsorted(at, heads)))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from rows with text and lang: whole-number sums, so every run and every split gives the same. The driver gets languages x DIMS numbers."""
    ready(docs.sparkSession)
    counted = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("weight", T.LongType())])
    bundled = T.StructType([T.StructField("lang", T.StringType()), T.StructField("dim", T.LongType()), T.StructField("weight", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, limits in blocks(batches):
            langs = batch.column("lang").dictionary_encode()
            codes, row = trigrams(data, limits)
            weight = np.maximum(1, TEXT_WEIGHT // np.maximum(1, np.bincount(row, minlength=len(limits) - 1)))
            known, at = np.unique(codes, return_inverse=True)
            own, at = np.unique(np.asarray(langs.indices)[row].astype(np.int64) * len(known) + at, return_inverse=True)
            total = np.bincount(at, weight[row], len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(own // max(1, len(known)))), pa.array(known[own % max(1, len(known))]), pa.array(total)], names=counted.names)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, codes, weight = np.asarray(batch.column("lang").to_pylist()), np.asarray(batch.column("code")), np.asarray(batch.column("weight"))
            for i in range(0, len(codes), 4096):
                v, w = vectors(codes[i : i + 4096]).astype(np.float64), weight[i : i + 4096]
                for lang in np.unique(langs[i : i + 4096]):
                    sums[lang] = sums.get(lang, 0) + np.rint(np.where(langs[i : i + 4096] == lang, w, 0).astype(np.float64) @ v).astype(np.int64)
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * DIMS), pa.array(np.arange(DIMS)), pa.array(x)], names=bundled.names)

    counts = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, counted).groupBy("lang", "code").agg(F.sum("weight").alias("weight"))
    found = counts.mapInArrow(bundle, bundled).groupBy("lang", "dim").agg(F.sum("weight").alias("weight")).collect()
    out: dict[str, np.ndarray] = {}
    for r in found:
        out.setdefault(r["lang"], np.zeros(DIMS))[r["dim"]] = r["weight"]
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in sorted(out.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all, if None) with lang_pred, score (cosine with its prototype, 0 to 1) and margin (to the next language)."""
    spark = ready(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("lang_pred", "score", "margin")]
    names = list(prototypes)
    shared = spark.sparkContext.broadcast(np.stack(list(prototypes.values())) if names else np.zeros((0, DIMS), np.float32))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, data, limits in blocks(batches, rows=512):
            n = len(limits) - 1
            codes, row = trigrams(data, limits)
            best, score, margin = np.full(n, len(names)), np.zeros(n), np.zeros(n)
            if names and len(codes):
                own, at = np.unique(codes, return_inverse=True)
                doc = np.zeros((n, DIMS), np.float32)
                for i in range(0, len(own), 8192):  # bundles the vectors of all trigrams, as often as each occurs
                    some = (at >= i) & (at < i + 8192)
                    m = min(8192, len(own) - i)
                    doc += np.bincount(row[some] * m + at[some] - i, minlength=n * m).astype(np.float32).reshape(n, m) @ vectors(own[i : i + m])
                length = np.sqrt(np.einsum("ij,ij->i", doc, doc))
                cosine = (doc @ known.T).astype(np.float64) / np.maximum(length, 1e-9)[:, None]
                some = np.bincount(row, minlength=n) > 0
                order = np.argsort(-cosine, axis=1, kind="stable")
                best = np.where(some, order[:, 0], best)
                top = np.take_along_axis(cosine, order[:, :2], 1)
                score = np.where(some, np.clip(top[:, 0], 0, 1), 0)
                margin = np.where(some, top[:, 0] - (top[:, 1] if len(names) > 1 else 0), 0)
            labels = pa.array([*names, "und"]).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in carry] + [labels, pa.array(np.round(score, 6)), pa.array(np.round(margin, 6))], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(label, schema)


def op2_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    prototypes = learn(docs.filter(part("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), prototypes, ["doc_id"]).select("doc_id", (part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin")
