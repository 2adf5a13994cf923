"""Record files: one RON text beside each image; with older forms brought up to date by a projection."""

from __future__ import annotations

import fcntl
import hashlib
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.functions.paths import sidecar_key
from loomset.functions.text import utrim
from loomset.schema import LEGACY, SIDECAR, or_default
from loomset.storage import importable

_RAW = f"{SIDECAR}, {LEGACY}, error string"


def migrate(records: DataFrame) -> DataFrame:
    """Older fields folded into the current ones: `caption` into captions under its model (or `legacy`) if it isn't blank and the key is free, lines of `caption_hint` into caption_hints.

    caption_hint_given tells whether there were any.
    """
    held = or_default(records)
    caption = F.col("caption") if "caption" in records.columns else F.lit(None).cast("string")
    model = F.coalesce(F.col("captioner.model"), F.lit("legacy")) if "captioner" in records.columns else F.lit("legacy")
    at = F.coalesce(F.col("captioner.captioned_at"), F.current_timestamp()) if "captioner" in records.columns else F.current_timestamp()
    usable = (utrim(F.coalesce(caption, F.lit(""))) != "") & ~F.map_contains_key("captions", model)
    folded = F.when(usable, F.map_concat("captions", F.create_map(model, F.struct(caption.alias("caption"), at.alias("captioned_at"), F.lit(False).alias("skip"))))).otherwise(F.col("captions"))
    hint = F.col("caption_hint") if "caption_hint" in records.columns else F.lit(None).cast("string")
    lines = F.filter(F.transform(F.split(F.coalesce(hint, F.lit("")), "\r?\n"), lambda x: utrim(x)), lambda x: x != "")
    fresh = F.array_except(F.array_distinct(lines), F.col("caption_hints"))
    return held.withColumn("captions", folded).withColumn("caption_hint_given", hint.isNotNull()).withColumn("caption_hints", F.concat("caption_hints", fresh)).drop("caption", "captioner", "caption_hint")


def _typed(value, kind: T.DataType):
    """A parsed value as the schema wants it: unknown fields are ignored, missing ones stay null."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _typed(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_typed(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: _typed(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.TimestampType):
        t = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return float(value) if isinstance(kind, T.FloatType) else value


def read(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """All records below a folder. A file that can't be parsed fails the job, or, if not strict, gives an empty record with its error."""
    files = importable(spark).read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ron").select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), F.col("value"))
    # paths come percent-encoded from file metadata
    keyed = files.select(F.url_decode(F.replace(sidecar_key(F.col("path")), F.lit("+"), F.lit("%2B"))).alias("key"), "value")
    return parsed(keyed, strict)


def parsed(keyed: DataFrame, strict: bool = True) -> DataFrame:
    """Records of texts (key, value)."""
    kinds = T.StructType.fromDDL(_RAW)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from loomset.sources.ron import loads

        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"], pdf["value"], strict=True):
                try:
                    tree, error = loads(text), None
                except ValueError as e:
                    if strict:
                        raise ValueError(f"{key}: {e}") from e
                    tree, error = {}, str(e)
                out.append({f.name: _typed(tree.get(f.name), f.dataType) for f in kinds.fields} | {"sidecar_key": key, "error": error})
            yield pd.DataFrame(out, columns=kinds.names).astype(object)

    return migrate(keyed.mapInPandas(parse, kinds)).drop("caption_hint_given")


def texts(records: DataFrame) -> DataFrame:
    """(sidecar_key, text): each record as it stands in its file."""
    fields = [f for f in T.StructType.fromDDL(SIDECAR).names if f != "sidecar_key"]

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if v is not None}
        if hasattr(x, "tolist") and not isinstance(x, str):
            x = x.tolist()
        if isinstance(x, list):
            return [plain(v) for v in x]
        return x.isoformat() if isinstance(x, datetime) else x

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from loomset.sources.ron import Map, Some, dumps

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                tree: dict = {}
                for f in fields:
                    v = plain(dict(r[f]) if f == "captions" and r[f] is not None else r[f])
                    if f in ("manual_tags", "auto_tags", "booru_tags"):
                        tree[f] = v or []
                    elif v is not None and v != [] and v != {}:
                        tree[f] = Map(v) if f == "captions" else v if f == "caption_hints" else Some(v)
                out.append(dumps(tree))
            yield pd.DataFrame({"sidecar_key": pdf["sidecar_key"], "text": out})

    return records.select("sidecar_key", *fields).mapInPandas(shown, "sidecar_key string, text string")


def _put(path: str, text: str) -> None:
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(f"{path}.tmp", path)


def write(records: DataFrame, folder: str = "/") -> DataFrame:
    """Writes each record beside its image, by a temporary file and a rename, and gives (path). Run by the caller's action; needs a folder that all executors share."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = [os.path.join(folder, f"{k}.ron") for k in pdf["sidecar_key"]]
            for path, text in zip(paths, pdf["text"], strict=True):
                _put(path, text)
            yield pd.DataFrame({"path": paths})

    return texts(records).mapInPandas(save, "path string")


def digest(text: str | bytes | None) -> str:
    """What tells a file's contents apart; of a missing file: empty."""
    return "" if text is None else hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def write_if_unchanged(records: DataFrame, folder: str = "/") -> DataFrame:
    """Writes the records (with `digest`, that of the file which each was read from) whose files still have that digest, and gives (sidecar_key, outcome): written or conflict.

    Check and rename happen under a lock on the file's folder, so of two writers with one digest one gets a conflict. A task that runs again finds
    its own text and counts it as written.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, expected in zip(pdf["sidecar_key"], pdf["text"], pdf["digest"], strict=True):
                path = os.path.join(folder, f"{key}.ron")
                place = os.open(os.path.dirname(path), os.O_RDONLY)
                try:
                    fcntl.flock(place, fcntl.LOCK_EX)
                    held = None
                    if os.path.exists(path):
                        with open(path, "rb") as f:
                            held = f.read()
                    now = digest(held)
                    if now == (expected or "") and now != digest(text):
                        _put(path, text)
                    out.append("written" if now in (expected or "", digest(text)) else "conflict")
                finally:
                    os.close(place)
            yield pd.DataFrame({"sidecar_key": pdf["sidecar_key"], "outcome": out})

    both = texts(records).join(records.select("sidecar_key", "digest"), "sidecar_key")
    return both.mapInPandas(save, "sidecar_key string, outcome string")
