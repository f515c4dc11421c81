"""Connected components by repeated contraction, entirely on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the
    smallest node that can be reached.

    Each round points every node to its smallest neighbour, jumps pointers once
    and contracts the edges to the targets, so at least every second node of an
    open component disappears. A pointer never rises, hence the last node of a
    component is its smallest. The driver sees only whether edges are left.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    rounds = []
    while True:
        edges = materialize(edges)
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b"))
        point = materialize(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        jump = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
        point = materialize(point.join(jump, "to").select("node", F.col("further").alias("to")))
        rounds.append(point)
        left = point.select(F.col("node").alias("a"), F.col("to").alias("na"))
        right = point.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        edges = (
            edges.join(left, "a").join(right, "b")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .where("a <> b").distinct()
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("to"), F.col("to").alias("further"))
        labels = labels.join(step, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    return labels.withColumnRenamed("to", "component")
