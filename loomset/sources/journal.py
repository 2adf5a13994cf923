"""File actions with a manifest written ahead, which a second run replays.

The manifest has each action with the size and digest of its source before anything is touched. An action is taken from the files as they are: a
copy goes to a temporary name, is compared with the manifest and renamed; a move removes its source only then. So a run that stopped anywhere is
finished by another run of the same manifest, and a run of what is finished changes nothing. Files that changed since are left alone and reported.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.storage import importable, shared_dir

MANIFEST = "src string, dst string, action string, bytes long, digest string"
OUTCOME = "src string, dst string, action string, outcome string"
#: Actions that a task takes, about.
TASK = 1000


def digest_of(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def with_records(actions: DataFrame) -> DataFrame:
    """(src, dst, action) of images, with those of the records beside them where has_record says so; images that share a record share its action."""
    ron = lambda c: F.concat(F.regexp_replace(c, r"\.[^./]*$", ""), F.lit(".ron"))
    both = F.array(F.struct("src", "dst"), F.when(F.col("has_record"), F.struct(ron("src").alias("src"), ron("dst").alias("dst"))))
    return actions.select("action", F.explode(both).alias("f")).filter("f IS NOT NULL").select("f.src", "f.dst", "action").distinct()


def plan(actions: DataFrame, folder: str) -> DataFrame:
    """Writes the manifest of actions (src, dst, action: move, copy or delete) to a new folder and reads it back. Fails if there is one, or if two actions have one target."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("src").to_pylist()
            sizes = [os.path.getsize(p) if os.path.exists(p) else None for p in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array([digest_of(p) for p in paths], pa.string())], [c.split()[0] for c in MANIFEST.split(", ")])

    importable(actions.sparkSession)
    chosen = actions.select("src", "dst", "action").distinct()
    twice = chosen.filter("dst IS NOT NULL").groupBy("dst").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['dst']}: two actions have this target")
    chosen.repartition(_tasks(chosen.count()), "src").mapInArrow(look, MANIFEST).write.parquet(folder)
    return actions.sparkSession.read.parquet(folder)


def _tasks(n: int) -> int:
    return max(1, -(-n // TASK))


def _act(src: str, dst: str | None, action: str, digest: str | None) -> str:
    now = digest_of(src)
    if action == "delete":
        if now is None:
            return "done"
        if now != digest:
            return "changed"
        os.remove(src)
        return "done"
    there = digest_of(dst)
    if there is None:
        if now is None:
            return "lost"
        if now != digest:
            return "changed"
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.copy2(src, f"{dst}.part")
        if digest_of(f"{dst}.part") != digest:
            os.remove(f"{dst}.part")
            return "changed"
        os.replace(f"{dst}.part", dst)
    elif there != digest:
        return "conflict"
    if action == "move" and now == digest:
        os.remove(src)
    return "done"


def replay(spark: SparkSession, folder: str, act: Callable[[str, str | None, str, str | None], str] = _act) -> DataFrame:
    """Takes the manifest's actions, or what is left of them, and gives OUTCOME: done, changed (the source isn't as planned), conflict (the target is another file) or lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, action, digest = (batch.column(c).to_pylist() for c in ("src", "dst", "action", "digest"))
            outcome = [act(*x) for x in zip(src, dst, action, digest, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("src", "dst", "action")), pa.array(outcome)], ["src", "dst", "action", "outcome"])

    importable(spark)
    held = spark.read.parquet(folder)
    out = f"{shared_dir(spark)}/loomset/outcome-{os.urandom(8).hex()}"
    held.repartition(_tasks(held.count()), "src").mapInArrow(run, OUTCOME).write.parquet(out)
    return spark.read.parquet(out)


def upscale(planned: DataFrame, factory: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """Makes the planned targets (src, dst, has_record; action upscale) and copies each record beside its target: OUTCOME, with done, present or the error.

    factory makes the model, once a task: bytes of an image to bytes of the larger one. Targets appear whole, and a second run makes only those that
    are missing; a record is copied after its image, and again while it's missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                src, dst = r["src"], r["dst"]
                try:
                    outcome = "present"
                    if not os.path.exists(dst):
                        with open(src, "rb") as f:
                            data = model(f.read())
                        os.makedirs(os.path.dirname(dst), exist_ok=True)
                        with open(f"{dst}.part", "wb") as f:
                            f.write(data)
                        os.replace(f"{dst}.part", dst)
                        outcome = "done"
                    a, b = (os.path.splitext(p)[0] + ".ron" for p in (src, dst))
                    if r["has_record"] and os.path.exists(a) and not os.path.exists(b):
                        shutil.copyfile(a, f"{b}.part")
                        os.replace(f"{b}.part", b)
                except Exception as e:  # one image's failure is its outcome, not the run's
                    outcome = str(e) or type(e).__name__
                rows.append((src, dst, "upscale", outcome))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, ["src", "dst", "action", "outcome"])

    spark = importable(planned.sparkSession)
    chosen = planned.filter("action = 'upscale'").select("src", "dst", "has_record")
    out = f"{shared_dir(spark)}/loomset/outcome-{os.urandom(8).hex()}"
    chosen.repartition(_tasks(chosen.count()), "src").mapInArrow(run, OUTCOME).write.parquet(out)
    return spark.read.parquet(out)
