"""Connected components by least label, with every step on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def least_reachable(links: DataFrame) -> DataFrame:
    """(node, label): for every node of links (a, b) the least node it can reach.

    Each round takes the least label among neighbours, then the label of that label, so chains
    shorten by half and more. Labels only fall; the rounds end when none does.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = stored(both.filter("a <> b"), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["node"])
                .groupBy("a").agg(F.min("label").alias("near")))
        low = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        moved = stored(low.join(up, "low", "left").select(
            "node", F.least("low", "up").alias("label"),
            (F.least("low", "up") < F.col("label")).alias("fell")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("fell").isEmpty():
            return labels
