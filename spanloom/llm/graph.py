"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of the edges; the label is the least node of the component.

    Each round takes the least label among a node's neighbours and then the label's own label,
    so paths shorten by a power of two; every round is cut off through the checkpoint folder.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = checkpointed(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        moved = checkpointed(moved)
        up = moved.select(F.col("node").alias("parent"), F.col("label").alias("higher"))
        jumped = moved.join(up, moved["label"] == up["parent"], "left").select(
            "node", "old", F.least("label", "higher").alias("label")
        )
        jumped = checkpointed(jumped)
        changed = jumped.where("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
