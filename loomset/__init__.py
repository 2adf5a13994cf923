"""Dataset curation and checkpoint analytics as Spark jobs."""
