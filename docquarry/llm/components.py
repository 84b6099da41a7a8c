"""Connected components in DataFrame operations: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import checkpoints


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of edges (a, b).

    Each round a node takes the least label among its neighbours, and then its
    label's label; labels only fall, and the loop ends when none does.  A hub with
    many neighbours is aggregated in parts before it is shuffled.
    """
    both = checkpoints.cut(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = checkpoints.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up_node"), F.col("label").alias("up"))
        new = lower.join(up, lower["label"] == up["up_node"], "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = checkpoints.cut(new)
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels
