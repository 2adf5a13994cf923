"""Token budgets of records: tokens of the exported tags and of the caption, apart and in all.

Tags recur in most records, so the list isn't encoded record by record: its text is cut after each comma, where a byte-level pre-tokeniser always
breaks (the next tag begins with a space and isn't blank), distinct pieces are encoded once, and their counts are joined back and summed. Lists for
which that break isn't certain (an empty or blank tag, or one that begins with white space) are a piece as a whole. Captions are mostly unlike
each other and are encoded as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomset.config import ExportProfile
from loomset.functions.text import utrim
from loomset.operators import captions as captioning
from loomset.operators import tags as tagging
from loomset.storage import importable

#: Texts that a task encodes at once.
BATCH = 512


def pieces(tags: Column) -> Column:
    """The text of tags, joined by a comma and a space with underscores shown as spaces, as pieces that can be encoded apart."""
    shown = F.transform(tags, lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    n = F.size(shown)
    cut = F.transform(shown, lambda t, i: F.concat(F.when(i > 0, " ").otherwise(""), t, F.when(i < n - 1, ",").otherwise("")))
    unsure = F.exists(shown, lambda t: (t == "") | (utrim(F.substr(t, F.lit(1), F.lit(1))) == ""))
    return F.when(unsure, F.array(F.array_join(shown, ", "))).otherwise(cut)


def counted(texts: DataFrame, text: str, tokenizer: str, name: str) -> DataFrame:
    """texts with `name`, the number of tokens of a string column by the tokenizer file (JSON), without special tokens; null and empty texts have none."""
    importable(texts.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        held = texts.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: its size doesn't follow the data
    schema = StructType([*texts.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(held.value)
        encoder.encode_special_tokens = True
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                n = [len(e.ids) for e in encoder.encode_batch([x or "" for x in part.column(text).to_pylist()], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], [*part.schema.names, name])

    return texts.mapInArrow(run, schema)


def budget(records: DataFrame, profile: ExportProfile, tokenizer: str, key: str = "sidecar_key") -> DataFrame:
    """(key, tag_tokens, caption_tokens, total) of each record: what a trainer gets, tags in their own order."""
    held = tagging.build_tags(records, ExportProfile(**{**profile.__dict__, "shuffle": False}), "_tags")
    both = held.select(key, pieces(F.col("_tags")).alias("pieces"), captioning.build_caption(profile, F.col("manual_tags"), F.col("manual_caption"), F.col("captions")).alias("caption"))
    each = both.select(key, F.explode("pieces").alias("piece")).groupBy(key, "piece").agg(F.count("*").alias("times"))
    memo = counted(each.select("piece").distinct(), "piece", tokenizer, "n")
    tag_tokens = each.join(memo, "piece").groupBy(key).agg(F.sum(F.col("n") * F.col("times")).alias("tag_tokens"))
    out = counted(both.select(key, "caption"), "caption", tokenizer, "caption_tokens").join(tag_tokens, key, "left")
    return out.select(key, F.coalesce("tag_tokens", F.lit(0)).alias("tag_tokens"), "caption_tokens").withColumn("total", F.col("tag_tokens") + F.col("caption_tokens"))
