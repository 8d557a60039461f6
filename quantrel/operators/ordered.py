"""Totals along a global order without bringing all rows into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MAX_BUCKETS = 2000


def percentiles(df: DataFrame, key: str) -> list[float]:
    """Approximate percentiles of a numeric key, one fewer than there are shuffle partitions; a frequent value comes more than once."""
    n = min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted(df.agg(F.percentile_approx(F.col(key).cast("double"), [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [])


def place(edges: list[float], x: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) if edges else F.lit(0)


def bucketed(df: DataFrame, key: str, out: str = "__bucket") -> DataFrame:
    """Adds the range bucket of a numeric key. Bucket edges part the work and change no result."""
    return df.withColumn(out, place(sorted(set(percentiles(df, key))), F.col(key).cast("double")))


def dealt(df: DataFrame, key: str, ties: tuple[str, ...]) -> DataFrame:
    """Adds __bucket and, within it, __sub. A value of the key that fills whole buckets gets one of its own, cut further by the first of `ties` if that is a number."""
    edges, k = percentiles(df, key), F.col(key).cast("double")
    hot = sorted({a for a, b in zip(edges, edges[1:], strict=False) if a == b})
    out = df.withColumn("__bucket", 2 * place(sorted(set(edges)), k) + F.coalesce(k.isin(hot).cast("int"), F.lit(0)) if hot else place(edges, k))
    sub = F.lit(0)
    if hot and ties and isinstance(df.schema[ties[0]].dataType, NumericType):
        tie = F.col(ties[0]).cast("double")
        shares = F.percentile_approx(tie, [i / (len(edges) + 1) for i in range(1, len(edges) + 1)], 10_000)
        for value, cuts in df.where(k.isin(hot)).groupBy(k.alias("k")).agg(shares.alias("e")).collect():  # a row for each hot value, fewer than the buckets
            sub = F.when(k == value, place(sorted(set(cuts or [])), tie)).otherwise(sub)
    return out.withColumn("__sub", sub)


def running_totals(df: DataFrame, key: str, sums: dict[str, str | Column], descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each row the sums of all rows up to and with it in the order of key (and ties).

    Rows are cut into range buckets; a bucket's rows are summed on from the totals of the buckets before it, a table of one
    row for each bucket.
    """
    cut, by = dealt(df, key, ties), ["__bucket", "__sub"]
    values = {out: F.expr(x) if isinstance(x, str) else x for out, x in sums.items()}
    first = F.col(key).desc() if descending else F.col(key).asc()
    local = Window.partitionBy(*by).orderBy(first, *ties).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*by).agg(*(F.sum(v).alias(f"__{o}") for o, v in values.items()))
    ahead = Window.orderBy(F.desc("__bucket") if descending else F.asc("__bucket"), "__sub").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, *(F.coalesce(F.sum(f"__{o}").over(ahead), F.lit(0)).alias(f"__{o}") for o in values))
    rows = cut.select("*", *(F.sum(v).over(local).alias(o) for o, v in values.items())).join(F.broadcast(totals), by)
    return rows.select(*df.columns, *((F.col(o) + F.col(f"__{o}")).alias(o) for o in values))


def numbered(df: DataFrame, key: str, out: str = "rn", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds row numbers from 1 in the global order of key (and ties)."""
    return running_totals(df, key, {out: F.lit(1).cast("long")}, ties=ties)


def running_minimum(df: DataFrame, key: str, x: str, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the least x of all rows up to and with each, in the order of key (and ties): within range buckets, then from the buckets before."""
    cut = bucketed(df, key)
    local = Window.partitionBy("__bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    lows = cut.groupBy("__bucket").agg(F.min(x).alias("__low")).select("__bucket", F.min("__low").over(ahead).alias("__low"))
    return cut.withColumn("__own", F.min(x).over(local)).join(F.broadcast(lows), "__bucket").select(*df.columns, F.least("__own", "__low").alias(out))


def exponential_moving(df: DataFrame, by: str, order: tuple[str, ...], x: str, momentum: float, out: str) -> DataFrame:
    """Adds m_t = momentum * m_(t-1) + (1 - momentum) * x_t from m_0 = 0. Rows whose weight is under 1e-17 are not looked at, so the frame is
    bounded however long a series is."""
    reach = math.ceil(math.log(1e-17) / math.log(momentum))
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(-reach, 0)
    last = F.collect_list(F.col(x).cast("double")).over(frame)
    return df.withColumn("__w", last).withColumn(out, F.aggregate("__w", F.lit(0.0), lambda m, v: m * momentum + v * (1 - momentum))).drop("__w")
