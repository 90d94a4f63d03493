"""Connected components of a graph given as edges, by alternating star contraction.

Each round links every node to the smallest node it knows (first the larger neighbours, then the
smaller ones) and writes the edges to the shared folder, so lineage stays short and a lost executor
costs no earlier round. The rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorcast.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; here b < a in each row."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has the long columns a and b, in any direction; repeats and loops do no harm, rows with
    a null are left out, and no edges give no rows.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stage(ordered.distinct(), "edges")
    before = None
    while True:
        current = stage(_small_star(_large_star(current)).distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = current.select("b").distinct().select(F.col("b").alias("a"), "b")
            return current.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
