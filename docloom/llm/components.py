"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for all nodes of links (a long, b long).

    Each round points every node to its smallest neighbour or itself, follows the
    pointers to their roots by doubling, and goes on with the links between roots;
    rounds at least halve the roots that still have links. Every table is written to
    the shared folder; nothing but counts reaches the driver. Joins on roots that
    many nodes share are sort-merge joins that adaptive execution may split.
    """
    labels = None
    edges = staged(links.select("a", "b").filter("a <> b").distinct())
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:
            next_ = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = staged(point.join(next_, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
            done = jumped.filter("moved").isEmpty()
            point = jumped.drop("moved")
            if done:
                break
        if labels is None:
            labels = point.withColumnRenamed("to", "label")
        else:
            up = point.select(F.col("node").alias("label"), F.col("to").alias("root"))
            labels = staged(labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        a = point.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        b = point.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = staged(edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    return labels
