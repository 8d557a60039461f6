"""Components of an edge table by smallest-label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def components(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, component (smallest key reachable); edges (a, b) count both ways."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(vertices.select(F.col(key).alias("v"), F.col(key).alias("l")))
    while True:
        around = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(around, labels["v"] == around["a"], "left").select("v", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("n"))
        jump = step.select(F.col("v").alias("n"), F.col("n").alias("nn"))
        step = cut(step.join(jump, "n").select("v", "old", F.least("n", "nn").alias("l")))
        if not step.where(F.col("old") != F.col("l")).limit(1).count():
            return step.select(F.col("v").alias(key), F.col("l").alias("component"))
        labels = step.select("v", "l")
