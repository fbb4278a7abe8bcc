"""Connected components by alternating large and small stars, all on tables.

Every round is written to the shared folder; nothing but a count comes to the driver.
Rounds grow with the logarithm of a component's size.

Defined results: edges of a node to itself and null nodes are passed over; repeated edges
count once, in whatever direction; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are hung on its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # A hub's rows are split by Spark: both sides of the join are plain exchanges.
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them (a > b holds)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return hung.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge (columns ``a``, ``b``); the root is the
    least node of its component and stands for itself too."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    edges = materialize(edges.distinct(), "cc-edges")
    while True:
        after = materialize(_small_star(_large_star(edges).distinct()).distinct(), "cc-edges")
        # Both are free of repeats: they are the same if none of the new ones is new, and
        # there are as many.
        same = after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
