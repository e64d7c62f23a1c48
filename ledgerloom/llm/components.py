"""Connected components of a table of links, in rounds whose number grows with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the least node of each connected component.

    Labels are hung under the labels of neighbours' labels and shortened in each round, so chains of any length settle in
    about the logarithm of their length; labels only ever fall, so the rounds end. Every round is a table in the shared folder that
    the next but one replaces. An empty table gives no row.
    """
    both = staged(links.select(F.col(a).alias("node"), F.col(b).alias("head")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("head"))), "both")
    labels = staged(both.groupBy("node").agg(F.min("head").alias("head")).select("node", F.least("node", "head").alias("component")), "labels")
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        tops = staged(labels.join(up, "component").select("node", "component", "top"), "tops")
        beside = both.join(tops.select(F.col("node").alias("head"), F.col("top").alias("found")), "head").groupBy("node").agg(F.min("found").alias("found"))
        offers = tops.join(beside, "node").select(
            F.explode(F.array(F.struct("node", F.least("top", "found").alias("c")), F.struct(F.col("component").alias("node"), F.least("top", "found").alias("c")))).alias("x")
        )
        new = staged(offers.groupBy("x.node").agg(F.min("x.c").alias("component")), "labels")
        moved = new.join(labels, ["node", "component"], "left_anti").limit(1).count()
        dropped(tops, labels)
        labels = new
        if not moved:
            dropped(both)
            return labels
