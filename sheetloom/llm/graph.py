"""Connected components in DataFrames, for link tables that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Rounds of least neighbouring label, each followed by a jump to the label's own label; partial minima go before every
    shuffle, so a hub costs no more than its edges. Ends when a round changes nothing.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("least", "label")).alias("new"))
        hop = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = cut(step.join(hop, step["new"] == hop["n2"], "left").select("node", F.least("new", F.coalesce("l2", "new")).alias("fresh"), "label"))
        done = new.where("fresh <> label").isEmpty()
        labels = new.select("node", F.col("fresh").alias("label"))
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
