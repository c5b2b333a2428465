"""Operators for pipelines of training data, each with a query over its whole table."""

from sheaf.llm.common import CHECKS, QUERIES  # noqa: I001
from sheaf.llm import alignment, lm_quality, mixing, near_dedup, packing, personal_data, quality_rules, recurrent, secrets, tiff, variants, warc, wrapper

__all__ = ["CHECKS", "QUERIES"]
