"""Tables that a job writes down on its way, in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions that set none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs on one machine (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomset-")
        place = _OWN[app]
    return place.rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, where the cluster wasn't given it by --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


class Scratch:
    """A run's own tables: each is written once and read back, so lineage ends there, and all go when the block ends. `keep` leaves one for the caller."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = importable(spark), uuid.uuid4().hex
        self.folder, self.tables = f"{shared_dir(spark)}/loomset/run-{self.name}", []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.folder + '-kept' if keep else self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """df as a table whose rows of a key lie in one bucket: joins and groups by the key read it where it lies."""
        table = f"loomset_{name}_{self.name}_{len(self.tables)}"
        self.tables.append(table)
        df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").option("path", f"{self.folder}/{table}").saveAsTable(table)
        return self.spark.table(table)


class Versions:
    """Whole versions of some tables in one folder: a reader sees the last one that was finished, a writer adds the next and drops those before the last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = importable(spark), folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.folder}/v*/FINISHED")) or []
        return sorted(int(x.getPath().getParent().getName()[1:]) for x in found)

    def read(self, name: str) -> DataFrame | None:
        last = self.numbers()[-1:]
        return self.spark.read.parquet(f"{self.folder}/v{last[0]}/{name}") if last else None

    def write(self, **tables: DataFrame) -> None:
        """All tables, or none: the mark that makes them readable comes last, and may be made once."""
        old = self.numbers()
        here = f"{self.folder}/v{(old or [0])[-1] + 1}"
        self._fs.delete(self._path(here), True)  # what an unfinished writer left
        for name, df in tables.items():
            df.write.parquet(f"{here}/{name}")
        self._fs.create(self._path(f"{here}/FINISHED"), False).close()
        for n in old[:-1]:
            self._fs.delete(self._path(f"{self.folder}/v{n}"), True)
