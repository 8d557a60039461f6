"""Fold ids and train/test splits as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def kfold(df: DataFrame, key: str, k: int) -> DataFrame:
    """fold: place in the order of key modulo k, so that folds differ by at most one row."""
    return numbered(df, key, "rn").withColumn("fold", (F.col("rn") - 1) % k).drop("rn")


def hashed_fold(df: DataFrame, k: int, *keys: str, seed: int = 0) -> DataFrame:
    """fold by hash alone: no order, no shuffle; sizes are equal in expectation. Rows that share the keys share a fold (group k-fold)."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)))


def stratified(df: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """fold: place within the stratum modulo k. Strata are numbered like kfold, bucket by bucket."""
    from .ordered import bucketed

    cut = bucketed(df, key)
    counts = cut.groupBy(stratum, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(stratum).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(stratum).alias("__s"), F.col("__bucket").alias("__b"), ahead.alias("__before"))
    rn = F.row_number().over(Window.partitionBy(stratum, "__bucket").orderBy(key))
    rows = cut.withColumn("__rn", rn).join(F.broadcast(counts), F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return rows.select(*df.columns, ((F.col("__before") + F.col("__rn") - 1) % k).cast("long").alias("fold"))


def forward_chaining(df: DataFrame, time: str, ties: tuple[str, ...], splits: int) -> DataFrame:
    """split, train and test sizes: split i trains on the first i parts of n // (splits + 1) rows and tests on the next."""
    n = df.count()
    size = n // (splits + 1)
    rows = numbered(df, time, "rn", ties)
    part = rows.select(F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("split"), "rn")
    return part.groupBy("split").agg(F.count_if(F.col("rn") <= F.col("split") * size).alias("train"), F.count_if((F.col("rn") > F.col("split") * size) & (F.col("rn") <= (F.col("split") + 1) * size)).alias("test"))
