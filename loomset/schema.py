"""Schemas of records, images and tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "manual_tags array<string>, auto_tags array<struct<tag:string,score:float,category:string>>, booru_tags array<struct<tag:string,category:string>>, captions map<string,struct<caption:string,captioned_at:timestamp,skip:boolean>>, manual_caption string, caption_hints array<string>, tagger struct<model:string,tagged_at:timestamp>, booru struct<source:string,post_id:bigint,post_url:string,fetched_at:timestamp>"
SIDECAR = f"sidecar_key string, {RECORD}"
#: Fields that older records hold besides.
LEGACY = "caption string, captioner struct<model:string,captioned_at:timestamp>, caption_hint string"
IMAGE = "image_path string, sidecar_key string, modified timestamp, bytes bigint"
TENSOR = "key string, dtype string, shape array<bigint>, ord bigint, data binary"

#: Published category numbers of the tag dictionary.
CATEGORIES = {0: "general", 1: "artist", 3: "copyright", 4: "character", 5: "meta", 9: "rating"}


def empty(field: str) -> str:
    """The value of a field that a record leaves out, as SQL."""
    kind = {f.name: f.dataType for f in T.StructType.fromDDL(SIDECAR)}[field]
    return f"cast({'array()' if isinstance(kind, T.ArrayType) else 'map()' if isinstance(kind, T.MapType) else 'null'} as {kind.simpleString()})"


def or_default(records: DataFrame) -> DataFrame:
    """Records with every field: missing columns and nulls get the field's default."""
    out = records
    for f in T.StructType.fromDDL(SIDECAR).fields[1:]:
        out = out.withColumn(f.name, F.coalesce(F.col(f.name), F.expr(empty(f.name))) if f.name in records.columns else F.expr(empty(f.name)))
    return out
