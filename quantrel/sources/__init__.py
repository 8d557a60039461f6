"""Tables and generated frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (array of doubles), label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def seeded_uniform(df: DataFrame, seed: int, *keys: str, out: str = "u") -> DataFrame:
    """A uniform in [0, 1) that depends on the seed and the keys alone, so a retried task draws the same."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return df.withColumn(out, h.cast("double") / F.lit(float(1 << 53)))


def gridworld(spark: SparkSession, size: int = 4, goal: int | None = None, step_reward: float = -1.0) -> DataFrame:
    """Deterministic grid: (s, a, s2, p, r); actions up, down, left, right; the goal keeps the walker without reward."""
    goal = size * size - 1 if goal is None else goal
    s, a = F.col("s"), F.col("a")
    row, col, last = F.floor(s / size), s % size, size - 1
    moved = (
        F.when(a == 0, F.greatest(row - 1, F.lit(0)) * size + col).when(a == 1, F.least(row + 1, F.lit(last)) * size + col)
        .when(a == 2, row * size + F.greatest(col - 1, F.lit(0))).otherwise(row * size + F.least(col + 1, F.lit(last)))
    )
    states = spark.range(size * size).select(F.col("id").alias("s"), F.explode(F.array(*map(F.lit, range(4)))).alias("a"))
    at_goal = s == goal
    return states.select("s", "a", F.when(at_goal, s).otherwise(moved).cast("long").alias("s2"), F.lit(1.0).alias("p"), F.when(at_goal, 0.0).otherwise(step_reward).alias("r"))
