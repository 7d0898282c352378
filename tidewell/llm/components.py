"""Connected components of an edge list, distributed: hook each node to a neighbour, contract, repeat.

In each round every node draws a random priority and hooks to its neighbour of least priority, if that is below its own; hooks
then are followed four steps up.  Priorities fall along hooks, so these never close a ring, and a node with neighbours keeps
its own place with a chance of at most one half: whatever the numbering or the shape (a sorted chain too), the nodes left are
expected to halve in each round, and rounds grow with the logarithm of their number.  Nothing is gathered on the driver.

Defined results: an edge of a node to itself, or with a null end, names no component; repeated and reversed edges count once;
without edges the result is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def contract(left: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One round over edges in both directions: each node's parent (node, p), and the edges between what is left."""
    drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("n"))
    parent = stored(left.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("least")).select("node", F.least(drawn("node"), F.col("least"))["n"].alias("p")))
    for _ in range(2):
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = stored(parent.join(up, "p").select("node", F.col("pp").alias("p")))
    of_a = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
    of_b = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
    return parent, stored(left.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: bigint columns a, b.  Returns node, root: each node that has an edge, and one node of its component."""
    left = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    roots, k = left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), 0
    while not left.isEmpty():
        parent, left = contract(left, k)
        moved = parent.select(F.col("node").alias("root"), F.col("p").alias("to"))
        roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        k += 1
    return roots
