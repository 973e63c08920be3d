"""Connected components by repeated contraction; the edges shrink by about half or more each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of edges; root is one arbitrary but fixed node of its component.

    Each round, each node takes the least of itself and its neighbours in a hashed order (so that long chains halve, too),
    and edges are redrawn between those; map-side minima and the skew-splitting joins bear hubs. Both tables are written
    to the shared folder each round. Nodes are longs; null ends and loops are left out.
    """
    order = lambda c: F.struct(F.xxhash64(c), c)
    edges = keep(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        step = keep(least.select(F.col("a").alias("node"), F.when(order(F.col("b")) < order(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("root")), "contraction")
        maps.append(step)
        moved = (
            edges.join(step, F.col("a") == F.col("node")).select(F.col("root").alias("a"), "b")
            .join(step, F.col("b") == F.col("node")).select("a", F.col("root").alias("b"))
        )
        edges = keep(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = maps[0]
    for step in maps[1:]:
        labels = labels.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return keep(labels, "components")
