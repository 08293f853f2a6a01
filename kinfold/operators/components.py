"""Connected components of a large graph (alternating large-star / small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.scratch import materialize


def _downhill(a: str, b: str):
    return F.greatest(a, b).alias("node"), F.least(a, b).alias("lower")


def _parents(links: DataFrame) -> DataFrame:
    """Lowest neighbour below each node; partial aggregation, so a hub costs one row per map task."""
    return links.groupBy("node").agg(F.min("lower").alias("parent"), F.count("*").alias("n_lower"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the lowest id of the component.

    Every edge is kept as (node, lower). One round re-hangs each edge below the parent of its lower end (large
    star), then hangs all lower ends of a node below its lowest one (small star). Both only move ends downwards.
    When every node has one lower end and that is a root, the stars are the components. Ids that follow the
    position of the nodes need fewer rounds than random ones.
    """
    links = edges.filter(F.col(a) != F.col(b)).select(*_downhill(a, b)).distinct()
    while True:
        links = materialize(links, "links")
        # A table of its own: a hub among the lower ends is then a plain skewed join, which Spark splits.
        parents = materialize(_parents(links), "parents")
        roots = parents.select(F.col("parent").alias("node")).distinct()
        if parents.filter("n_lower > 1").isEmpty() and parents.join(roots, "node", "left_semi").isEmpty():
            return parents.select("node", F.col("parent").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
        up = parents.select(F.col("node").alias("lower"), "parent")
        large = links.join(up, "lower", "left").select("node", F.coalesce("parent", "lower").alias("lower"))
        lowest = _parents(large)
        small = large.join(lowest, "node").filter("lower > parent").select(F.col("lower").alias("node"), "parent")
        links = lowest.select("node", "parent").unionByName(small).distinct().withColumnRenamed("parent", "lower")
