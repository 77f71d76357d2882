"""Connected components of an edge table by repeated contraction, without a driver-side union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every endpoint of edges (a long, b long): label is the smallest node reachable.

    In each round every node moves to its smallest neighbour and the edges follow it there; edges that
    became loops go. The number of nodes shrinks by a factor each round, so there are logarithmically
    many. A node with very many neighbours is met by partial minima and skew-split joins only.
    """
    edges = durable(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        moves = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        if labels is None:
            following = moves.withColumnRenamed("to", "label")
        else:
            following = labels.join(moves.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        following = durable(following)
        moved = edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(moves.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        left = durable(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        for old in (edges, moves, labels):
            if old is not None:
                release(old)
        edges, labels = left, following
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
