"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.kernels import kept


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of links; label is the least node of its component.

    Links with a null end are ignored; an empty table gives an empty table.  Each round takes every
    node's least label among its neighbours and then follows that label once more, so that chains shrink
    by halves.  Labels are reduced by key before they are shuffled; a hub is therefore no hot task.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = kept(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = kept(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        best = labels.join(near, labels.node == near.x, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("best"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("over"))
        after = kept(best.join(up, best.best == up.up, "left").select("node", F.col("label").alias("was"), F.least("best", F.coalesce("over", "best")).alias("label")), "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
