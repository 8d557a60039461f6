"""Isotonic calibration by pooling adjacent violators, within range buckets first and then over their blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import bucketed

#: Blocks that the driver may pool in the end.
BLOCKS = 1_000_000


def pool_adjacent(mean: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, int, int]]:
    """(mean, weight, first, last) of the blocks of the rising fit."""
    out: list[tuple[float, float, int, int]] = []
    for i, (m, w) in enumerate(zip(mean, weight, strict=True)):
        first = i
        while out and out[-1][0] >= m:
            pm, pw, first, _ = out.pop()
            m, w = (pm * pw + m * w) / (pw + w), pw + w
        out.append((m, w, first, i))
    return out


def isotonic(df: DataFrame, score: str, y: str) -> list[tuple[float, float, float]]:
    """(low score, high score, value) of each block, by rising score; rows of equal score are pooled first.

    Pooling within a bucket only joins what pooling over all rows joins, so the buckets' blocks give the same fit.
    """
    points = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.avg(F.col(y).cast("double")).alias("m"), F.count(F.lit(1)).cast("double").alias("w"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        s = pdf["s"].to_numpy()
        return pd.DataFrame([(s[a], s[b], m, w) for m, w, a, b in pool_adjacent(pdf["m"].to_numpy(), pdf["w"].to_numpy())], columns=["low", "high", "m", "w"])

    blocks = bucketed(points, "s").groupBy("__bucket").applyInPandas(local, "low double, high double, m double, w double")
    rows = blocks.orderBy("low").limit(BLOCKS + 1).collect()
    if len(rows) > BLOCKS:
        raise ValueError(f"isotonic fits of more than {BLOCKS} blocks are not held")
    return [(rows[a]["low"], rows[b]["high"], m) for m, _, a, b in pool_adjacent(np.array([r["m"] for r in rows]), np.array([r["w"] for r in rows]))]


def calibrate(df: DataFrame, score: str, blocks: list[tuple[float, float, float]], out: str = "calibrated") -> DataFrame:
    """Adds the fitted value: linear between blocks, constant beyond the ends."""
    x = np.array([v for low, high, _ in blocks for v in (low, high)])
    y = np.array([m for _, _, m in blocks for _ in (0, 1)])

    @F.pandas_udf("double")
    def fit(s: pd.Series) -> pd.Series:
        return pd.Series(np.interp(s.to_numpy(float), x, y))

    return df.withColumn(out, fit(F.col(score).cast("double")))
