"""Connected components of a link table, without collecting links anywhere.

Each round hooks every vertex to its smallest neighbour and contracts the graph; vertices that still have links at
least halve, so there are about log2(n) rounds at most (two or three for star-like groups).  Every round is cut into
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """``links (a, b)`` -> ``(v, component)`` for every vertex that has a link to another; component is the smallest vertex."""
    both = links.where("a <> b").select("a", "b")
    edges = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        parent = cut(edges.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")), "parent")
        if labels is None:
            new = parent.select("v", F.col("p").alias("component"))
        else:
            new = labels.join(parent.withColumnRenamed("v", "component"), "component", "left").select("v", F.coalesce("p", "component").alias("component"))
        new = cut(new, "labels")
        a, b = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        joined = edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        then = cut(joined.distinct(), "edges")
        for old in (edges, labels, parent):
            discard(old)
        edges, labels = then, new
    discard(edges)
    if labels is None:
        kind = links.schema["a"].dataType
        return links.sparkSession.createDataFrame([], "v {0}, component {0}".format(kind.simpleString()))
    return labels
