"""Connected components of an edge table by contraction, kept in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b): the label is the smallest node of its component.

    In each round a node takes the smallest of itself and its neighbours, then what that one has taken; edges
    are renamed to labels, and those within a label go, so rounds shrink. Labels of rounds are chained at the
    end. An empty table gives no rows.
    """
    links = cut(_between(edges, "a", "b"))
    labels = cut(_nearest(links))
    if links.isEmpty():
        return labels
    found = labels
    while True:
        left = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        links = cut(_between(left.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b"), "x", "y"))
        if links.isEmpty():
            return found
        labels = cut(_nearest(links))
        found = cut(found.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label")))


def _between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair of different ends once, as (a, b) with the smaller first."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _nearest(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a"))
    near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    return near.join(near.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.col("far").alias("label"))
