"""Record operators over streams: they're projections of one record, so they run unchanged on readStream and keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomset.config import ExportProfile
from loomset.operators import groups, tags


def export(records: DataFrame, profile: ExportProfile, folder: str, checkpoint: str, key: str = "sidecar_key") -> StreamingQuery:
    """Exports records as they arrive: (key, text) as Parquet, exactly once, until what is there now is done."""
    out = tags.export_text(records, profile).select(key, "text")
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def problems(records: DataFrame, group: list[str], folder: str, checkpoint: str, key: str = "sidecar_key") -> StreamingQuery:
    """Records that break an exclusive group, as they arrive."""
    out = groups.problems(groups.classify(records, group)).select(key, "classification")
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
