"""Connected components of an edge list, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connect(edges: DataFrame, name: str) -> DataFrame:
    """``v, root`` for every vertex of the edges ``a, b``; the root is one of its component's vertices.

    Each round gives the vertices a new random order, contracts every vertex into
    the least of itself and its neighbours, and relabels the edges; expected
    rounds grow with the logarithm of the vertices. Minima combine on the map side,
    so a vertex with many neighbours is no burden. Every round is written to the
    shared folder.
    """
    edges = materialize(edges.where("a <> b").distinct(), name)
    assigned = None
    round_ = 0
    while not edges.isEmpty():
        round_ += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("o"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("v"), F.least(F.col("m"), order("a"))["v"].alias("to"))
        least = materialize(least, f"{name}-step")
        if assigned is None:
            assigned = least.withColumnRenamed("to", "root")
        else:
            step = least.select(F.col("v").alias("root"), "to")
            assigned = assigned.join(step, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        assigned = materialize(assigned, f"{name}-assigned")
        left = least.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        right = least.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct()
        edges = materialize(edges, f"{name}-edges")
    if assigned is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return assigned
