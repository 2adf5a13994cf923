"""Record operators over a stream equal those over a table."""

from loomset.config import ANIMA
from loomset.operators import tags
from loomset.plans.derive import records
from loomset.streaming import records as streamed


def test_export_as_a_stream(spark, tmp_path):
    table = records(spark, "/root/testdata/sf0.001")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    streamed.export(stream, ANIMA, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    want = sorted(tuple(r) for r in tags.export_text(table, ANIMA).select("sidecar_key", "text").collect())
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    streamed.problems(stream, ["_reviewed", "error"], str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).filter("classification.state = 'tag'").count() == 0
