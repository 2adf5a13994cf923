"""All queries outside the llm subpackage, with the SQL each must equal."""

from __future__ import annotations

from loomset.plans import checkpoint_queries, record_queries, tensor_queries

QUERIES = {**record_queries.QUERIES, **tensor_queries.QUERIES, **checkpoint_queries.QUERIES}
ORACLES = {**record_queries.ORACLES, **tensor_queries.ORACLES, **checkpoint_queries.ORACLES}
