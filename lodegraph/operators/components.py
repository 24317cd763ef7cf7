"""Connected groups of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import written


def connected(links: DataFrame) -> DataFrame:
    """(id, root) of every id in `links` (a long, b long); ids are hashes, so their order is as good as random.

    In a round every id moves to the least of itself and its neighbours and on
    to where that one moves, then links are drawn anew between where their
    ends went. A random order makes a chain of n links a constant factor
    shorter each time, so rounds grow with the logarithm of n; a hub is
    folded by map-side minima. A link of an id to itself only names the id.
    """
    nodes = written(links.select("a").union(links.select("b")).distinct().toDF("id"))
    edges = written(links.where("a <> b").distinct())
    root = nodes.withColumn("root", F.col("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("to")))
        step = written(least.join(least.toDF("to", "onward"), "to").select("id", F.col("onward").alias("to")))
        moved = root.join(step.toDF("root", "to"), "root", "left")
        root = written(moved.select("id", F.coalesce("to", "root").alias("root")))
        ends = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return root
