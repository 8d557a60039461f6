"""Connected components of a link table, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, new_path

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links(a, b): root is the smallest vertex that v reaches.

    Large-star and small-star steps alternate until the link table stands still. Minima are partial
    aggregates and the join with them is an ordinary shuffled join, so a vertex with very many links is
    combined before the shuffle and split by the adaptive skew join. Every round is written to the shared folder.
    """
    spark = links.sparkSession
    path = new_path(spark, "links")
    links = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", path)
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")).select(F.col("a").alias("u"), "m")
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where(F.col("a") != F.col("b")).distinct()
        later = new_path(spark, "links")
        links = materialise(small, "links", later)
        forget(spark, path)
        path = later
        now = links.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root").union(links.select("b", "b").distinct())
        before = now
    raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")
