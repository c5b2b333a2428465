"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written


def _larger(edges: DataFrame) -> DataFrame:
    """Give every larger neighbour of a node the least one of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges go from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that occurs in the links (u, v), integers.

    Alternates two steps that replace links by links to least neighbours until every component is
    a star around its least node; the rounds grow with the logarithm of its size, not with its
    diameter. Each step is a minimum per node, combined before the shuffle, and a join that
    adaptive execution can split. Null ends and self links are ignored; no links, no rows.
    """
    edges = (
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        edges = written(_smaller(_larger(edges)).where("u <> v").distinct(), "edges")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
