"""Trainer formats: a text file for each image, one JSON object, JSON lines; and moves and deletions of files by plan."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions.paths import with_extension
from loomset.storage import Scratch


def sd_scripts_entries(pairs: DataFrame) -> DataFrame:
    """(image_path, entry): JSON with caption and tags where present; images with neither are left out."""
    return pairs.filter("caption IS NOT NULL OR tags IS NOT NULL").select("image_path", F.to_json(F.struct("caption", "tags")).alias("entry"))


def write_sd_scripts(pairs: DataFrame, path: str) -> None:
    """One JSON object keyed by path, in order of path. Sorted ranges of entries are written by executors at their places in the file; the driver sees the ranges' sizes."""
    from loomset.sources import tensorfile

    key = F.regexp_extract(F.to_json(F.struct(F.col("image_path").alias("p"))), r'(?s)^\{"p":(.*)\}$', 1)
    line = F.concat(F.lit(",\n  "), key, F.lit(": "), F.col("entry")).cast("binary")
    with Scratch(pairs.sparkSession) as run:
        lines = run.settle(sd_scripts_entries(pairs).select("image_path", "entry", line.alias("data")), "lines")
        order = ["image_path", "entry"]
        ranged = run.settle(lines.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
        sizes = ranged.groupBy("range").agg(F.sum(F.octet_length("data")).alias("n")).withColumn("start", F.sum("n").over(W.orderBy("range")) - F.col("n"))
        sizes = run.settle(sizes, "sizes")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        inside = W.partitionBy("range").orderBy(*order)
        upto = F.sum(F.octet_length("data")).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
        placed = ranged.join(F.broadcast(sizes), "range").withColumn("at", F.col("start") + upto - F.octet_length("data"))
        # the first line has no comma before it: the head takes its place
        body = placed.select(F.lit("body").alias("key"), F.greatest(F.col("at") - 1, F.lit(0)).alias("at"), F.when(F.col("at") == 0, F.substr("data", F.lit(2))).otherwise(F.col("data")).alias("data"))
        length = max(total - 1, 0)
        tail = pairs.sparkSession.createDataFrame([("tail", 0, b"\n}\n")], "key string, at long, data binary")
        tensorfile.put(body.unionByName(tail), path, b"{", {"body": (1, 1 + length), "tail": (1 + length, 4 + length)}, 4 + length)


def musubi_lines(pairs: DataFrame) -> DataFrame:
    """(value): JSON lines by (path, caption); images without a caption are left out."""
    return pairs.filter("caption IS NOT NULL").orderBy("image_path", "caption").select(F.to_json(F.struct("caption", "image_path")).alias("value"))


def write_musubi(pairs: DataFrame, folder: str) -> None:
    musubi_lines(pairs).write.mode("overwrite").text(folder)


def _each(df: DataFrame, act, schema: str = "path string") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": [act(*r) for r in pdf.itertuples(index=False)]})

    return df.mapInPandas(run, schema)


def write_texts(texts: DataFrame) -> DataFrame:
    """Writes texts (image_path, text) to .txt files beside the images, whole or not at all, and gives the paths written."""

    def save(path: str, text: str) -> str:
        with open(f"{path}.tmp", "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(f"{path}.tmp", path)
        return path

    return _each(texts.select(with_extension(F.col("image_path"), "txt").alias("path"), "text"), save)


def run_moves(plan: DataFrame, dry_run: bool = False) -> DataFrame:
    """Moves the planned pairs of image and record; (path) of each that moved, or would move."""
    chosen = plan.filter("action = 'move'")
    if dry_run:
        return chosen.select(F.col("src").alias("path"))

    def move(src: str, dst: str, has_record: bool) -> str:
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        for a, b in [(src, dst)] + ([(os.path.splitext(src)[0] + ".ron", os.path.splitext(dst)[0] + ".ron")] if has_record else []):
            if os.path.exists(a):  # a task that runs again finds some moved
                shutil.move(a, b)
        return src

    return _each(chosen.select("src", "dst", "has_record"), move)


def delete_images(images: DataFrame, paths: DataFrame) -> DataFrame:
    """Deletes the named images and their records; a record goes only with the last image that shares it."""
    gone = images.join(paths.select("image_path").distinct(), "image_path", "left_semi")
    kept = images.join(paths.select("image_path").distinct(), "image_path", "left_anti").select("sidecar_key", F.lit(True).alias("_kept")).distinct()

    def delete(path: str, key: str, kept: bool) -> str:
        for x in [path] + ([] if kept else [f"{key}.ron"]):
            if os.path.exists(x):
                os.remove(x)
        return path

    return _each(gone.join(kept, "sidecar_key", "left").select("image_path", "sidecar_key", F.coalesce("_kept", F.lit(False))), delete)


def write_verify_report(errors: DataFrame, folder: str) -> None:
    """TSV of layer errors: relerr_pct, cosine, groupsize, layer."""
    errors.select(F.format_string("%.4f", "relerr").alias("relerr_pct"), F.format_string("%.6f", "cosine").alias("cosine"), F.col("gs").alias("groupsize"), F.col("base").alias("layer")).write.mode("overwrite").csv(folder, sep="\t", header=True)
