"""Projection that is not repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *cols: Column | str) -> DataFrame:
    """Select whose expressions are evaluated once per row.

    A plain projection is merged into whatever refers to it, filters and array lambdas included,
    which would repeat a text scan many times over. A generator is not merged.
    """
    return df.select(F.inline(F.array(F.struct(*cols))))
