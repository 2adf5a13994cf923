"""A corpus pipeline of five stages over `documents`: language identification, line deduplication, near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Extra columns are carried; rows with
null ids or texts go through every stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import decontaminate, lang_id, line_dedup, mix_sources, near_dedup
from loomset.llm.common import discard, passing, settle
from loomset.llm.names import apart

#: A text goes if its best cosine isn't above a bound: it looks like no language learned. The bound rises from 0 at FEW trigrams, so that texts of a
#: few words stay, to LEAST_COSINE at MANY. Calibrated on sf0.01: letters at random, in any script, reach 0.14 at most, documents of 28
#: trigrams and more 0.248 at least.
LEAST_COSINE = 0.16
FEW, MANY = 24, 84


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language learned from docs, go."""
    own, back = apart(docs, ("lang_pred", "score", "margin"))
    seen = lang_id.identify(own, lang_id.learn(docs))
    trigrams = F.length(F.regexp_replace("text", r"\P{L}", ""))  # one with each letter in its middle
    bound = F.greatest(F.lit(0.0), LEAST_COSINE * (trigrams - FEW) / (MANY - FEW))
    return back(seen.filter((F.col("lang_pred") != "und") & ((F.col("score") > LEAST_COSINE) | (F.col("score") > bound))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages of lines are cut from all texts but the first; a document of which nothing but white space is left goes. n_chars follows the text."""
    own, back = apart(docs, line_dedup.ADDED)
    cut = line_dedup.dedup_lines(own, passages=True).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(cut)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id; rows are told by id and words, so a repeated id costs no other text."""
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    own, back = apart(docs, decontaminate.ADDED)
    seen = decontaminate.find(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(seen.filter(F.size("spans") == 0))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that a source's budget takes, cut at the budget, with size, source_size, target, taken and epoch in place of columns of those names."""
    return mix_sources.materialise(mix_sources.mix(docs))


STAGES = [("language", language), ("lines", lines), ("near", near), ("decontaminated", decontaminated), ("mixed", mixed)]

#: Language identification, chunking by rolling hashes and Order MinHash have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet in the shared folder and read again; it goes when the next one's is written, as do a stage's own tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *earlier, (_, last) = STAGES
    for k, (name, stage) in enumerate(earlier):
        before = docs
        with passing(spark):
            docs = settle(stage(spark, before, sf_dir), f"stage-{name}", keep=True)
        if k:
            discard(before)
    return last(spark, docs, sf_dir)
