"""Images in a folder tree, without reading their bytes unless asked to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.paths import is_image, sidecar_key


def scan(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(image_path, sidecar_key, modified, bytes[, content]) of all images below a folder. Order is undefined until asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(is_image(F.col("path")))
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(path.alias("image_path"), sidecar_key(path).alias("sidecar_key"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), *(["content"] if content else []))


def with_records(images: DataFrame, records: DataFrame, missing: str = "left") -> DataFrame:
    """Images with their records: left keeps images without one (for edits and status), inner skips them (for export). Images that share a record each get it."""
    return images.join(records, "sidecar_key", missing)
