"""Order statistics by ranges, and token budgets, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.config import ExportProfile
from loomset.operators import stats, tags, token_budget

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SHARES = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


def _brute(values):
    ordered = sorted(v for v in values if v is not None)
    at = lambda p: int(np.floor(np.float32(np.float32(len(ordered) - 1) * np.float32(p)) + np.float32(0.5)))
    return [ordered[at(p)] if ordered else None for p in SHARES.values()] + [ordered[-1] if ordered else None, len(ordered)]


@pytest.mark.parametrize("values", [[], [None], [7], [1, 2, 3, 4], [5] * 40 + [1], list(range(1000)), [random.Random(3).randrange(10**6) for _ in range(3000)] + [None, None], [-3, -3, 0, 2**40]])
def test_nearest_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    assert list(stats.nearest_rank(df, "v", SHARES).first()) == _brute(values)


def test_nearest_rank_orders_only_the_ranges_it_needs(spark, monkeypatch):
    """No window is over all values: the only one without a partition is over the sums of ranges."""
    from loomset import storage

    plans, settle = [], storage.Scratch.settle

    def seen(self, df, name, keep=False):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return settle(self, df, name, keep)

    monkeypatch.setattr(storage.Scratch, "settle", seen)
    df = spark.range(5000).select((F.col("id") * 7919 % 4999).alias("v"))
    assert list(stats.nearest_rank(df, "v", SHARES).first()) == _brute([i * 7919 % 4999 for i in range(5000)])
    assert [name for name, plan in plans if "Window" in plan] == ["sums"]


def _record(i, manual, auto, caption):
    return (f"k{i}", manual, [(t, 0.9, "general") for t in auto], [], caption, {}, None)


SCHEMA = "sidecar_key string, manual_tags array<string>, auto_tags array<struct<tag:string,score:float,category:string>>, booru_tags array<struct<tag:string,category:string>>, manual_caption string, captions map<string,struct<caption:string,captioned_at:timestamp,skip:boolean>>, more string"


def test_budget_equals_encoding_whole_texts(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(9)
    words = ["sea_wall", ":)", "1girl", "o_o", "blue sky's", "it's", "<|endoftext|>", "naïve", "日本_語", "a.", "(b)", "x,", "--flag", "3d", "_", "...", "new\tline", "smile :d"]
    rows = [_record(i, rng.sample(words, rng.randint(0, 6)), rng.sample(words, rng.randint(0, 8)), rng.choice([None, "", " a caption, with  words\nand lines ", "<|endoftext|> it's", "é" * 3000])) for i in range(120)]
    records = spark.createDataFrame(rows, SCHEMA).repartition(3)
    profile = ExportProfile()
    got = {r["sidecar_key"]: r for r in token_budget.budget(records, profile, TOKENIZER).collect()}
    shown = {r["sidecar_key"]: r for r in tags.export_text(records, profile).collect()}
    assert set(got) == set(shown) and len(got) == 120
    encoder.encode_special_tokens = True
    n = lambda x: len(encoder.encode(x, add_special_tokens=False).ids) if x else 0
    for k, r in shown.items():
        caption = (r["manual_caption"] or "").strip()
        assert (got[k]["tag_tokens"], got[k]["caption_tokens"]) == (n(r["text"]), n(caption)), (r["text"], caption)
        assert got[k]["total"] == got[k]["tag_tokens"] + got[k]["caption_tokens"]


def test_pieces_of_unsure_lists_stay_whole(spark):
    lists = [["a", " b"], ["a", ""], ["a", "b"], [], None, ["_a", "b"]]
    rows = spark.createDataFrame([(x,) for x in lists], "t array<string>").select(token_budget.pieces(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in rows] == [["a,  b"], ["a, "], ["a,", " b"], [], None, [" a, b"]]
    assert token_budget.counted(spark.createDataFrame([(None,), ("",), ("a b",)], "x string"), "x", TOKENIZER, "n").agg(F.sum("n")).first()[0] == 2
