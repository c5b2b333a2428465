"""Positions inside a group, also when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import checkpoint

HOT_GROUP_ROWS = 2_000_000
#: Values of a position that running sums take together.
CHUNK = 1 << 16


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str,
                 hot_group_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Zero-based position of each row within its ``keys`` group, by ``order``.

    ``order`` must be unique within a group. The group sizes are counted first from the key
    columns alone. As long as the largest stays under ``hot_group_rows`` one window does the work.
    Beyond that :func:`ranged_ordinal` ranks with no task ever holding a whole group.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > hot_group_rows:
        return ranged_ordinal(df, keys, order, out)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint") - 1)


def ranged_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   out: str) -> DataFrame:
    """Range-partition by key and order, number within each slice, add the slice offsets.

    The sliced rows are checkpointed: the number of a row depends on the sampled range bounds, and
    a recomputation after a lost executor must not draw new ones. Per group there are at most as
    many slices as shuffle partitions, so the running total over slices is small.
    """
    sortable = [f"__order_{i}" for i in range(len(order))]
    keyed = df.select("*", *[o.alias(n) for n, o in zip(sortable, order)])
    sliced = checkpoint(
        keyed.repartitionByRange(*keys, *sortable)
        .sortWithinPartitions(*keys, *sortable)
        .drop(*sortable)
        .withColumn("__slice", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id())
    )
    slices = sliced.groupBy(*keys, "__slice").agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first")
    )
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *keys, "__slice", "__first",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
    )
    return (
        sliced.join(offsets, [*keys, "__slice"])
        .withColumn(out, F.col("__offset") + F.col("__at") - F.col("__first"))
        .drop("__slice", "__at", "__first", "__offset")
    )


def running_sums(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str],
                 chunk: int = CHUNK) -> DataFrame:
    """``<value>_before`` for each of ``values``: its sum over the rows of the group with a smaller
    ``position``, an integer that is unique within the group.

    Positions are taken in chunks. Sums of chunks are added up along the group, which has few of
    them, and rows within their chunk, so no task meets more of a group than one chunk.
    """
    chunked = df.withColumn("__chunk", F.floor(F.col(position) / F.lit(chunk)))
    own = [*keys, "__chunk"]
    sums = chunked.groupBy(*own).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    chunks = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*own, *[F.coalesce(F.sum(f"__{v}").over(chunks), F.lit(0)).alias(f"__{v}") for v in values])
    rows = Window.partitionBy(*own).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return chunked.join(offsets, own).withColumns(
        {f"{v}_before": F.col(f"__{v}") + F.coalesce(F.sum(v).over(rows), F.lit(0)) for v in values}
    ).drop("__chunk", *[f"__{v}" for v in values])
