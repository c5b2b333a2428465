"""The engine's operators as queries over the given tables."""

from workload.registry import CHECKS, QUERIES  # noqa: I001
from workload import files_queries, bundle_queries, catalog_queries, log_queries, sink_queries

flagship = bundle_queries.flagship

__all__ = ["CHECKS", "QUERIES", "flagship"]
