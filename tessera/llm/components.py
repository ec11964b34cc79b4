"""Connected components by label propagation with pointer jumping, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), both long, to (node, label): the smallest node reachable, for every node of an edge.

    Each round takes the least label among neighbours and then follows the label once, so a
    chain of n links needs about log n rounds. Labels are written each round; a hot node's
    edges are joined from written tables, which adaptive execution may split.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        least = cut(near.union(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = cut(least.join(up, "label").select("node", F.col("up").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:  # labels only fall, so an equal sum means that none has changed
            break
        total = now
    return labels
