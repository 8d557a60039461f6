"""Entropy, divergence and information from count tables."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(df: DataFrame, x: str, base: float = math.e) -> DataFrame:
    n = df.where(F.col(x).isNotNull()).groupBy(x).count()
    # H = ln N - sum n ln n / N
    return n.agg(((F.ln(F.sum("count")) - F.sum(F.col("count") * F.ln("count")) / F.sum("count")) / math.log(base)).alias("entropy"))


def joint(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n, nx, ny, total from one grouping; margins sum the small table."""
    n = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("x", "y", "n", F.sum("n").over(Window.partitionBy("x")).alias("nx"), F.sum("n").over(Window.partitionBy("y")).alias("ny"), F.sum("n").over(Window.partitionBy()).alias("total"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """joint, conditional H(y | x) and mutual information, in nats, and the information gain in bits."""
    p = F.col("n") / F.col("total")
    return joint(df, x, y).agg(
        F.sum(-p * F.ln(p)).alias("joint_entropy"), F.sum(-p * F.ln(F.col("n") / F.col("nx"))).alias("conditional_entropy"),
        F.sum(p * F.ln(F.col("n") * F.col("total").cast("double") / (F.col("nx") * F.col("ny")))).alias("mutual_information"),
        F.sum(p * F.log2(F.col("n") * F.col("total").cast("double") / (F.col("nx") * F.col("ny")))).alias("information_gain"),
    )


def divergences(df: DataFrame, x: str, in_p: Column) -> DataFrame:
    """KL(p || q), cross-entropy (infinite where q lacks a value of p) and Jensen-Shannon of x in the rows where in_p holds and the others."""
    c = df.groupBy(x).agg(F.count_if(in_p).alias("a"), F.count_if(~in_p).alias("b"))
    every = Window.partitionBy()
    c = c.select((F.col("a") / F.sum("a").over(every)).alias("p"), (F.col("b") / F.sum("b").over(every)).alias("q"))
    p, q, inf = F.col("p"), F.col("q"), F.lit(float("inf"))
    m = (p + q) / 2
    term = lambda u, v: F.when(u == 0, 0.0).when(v == 0, inf).otherwise(u * F.ln(u / v))
    return c.agg(F.sum(term(p, q)).alias("kl"), F.sum(F.when(p == 0, 0.0).when(q == 0, inf).otherwise(-p * F.ln(q))).alias("cross_entropy"), F.sum((term(p, m) + term(q, m)) / 2).alias("js"))


def perplexity(df: DataFrame, log_prob: str) -> DataFrame:
    return df.agg(F.exp(-F.avg(log_prob)).alias("perplexity"))


def huffman(counts: dict) -> dict:
    """Prefix code of a count table; equal weights merge in the order they came."""
    if len(counts) == 1:
        return dict.fromkeys(counts, "0")
    heap = [(w, i, (k,)) for i, (k, w) in enumerate(sorted(counts.items(), key=lambda x: str(x[0])))]
    heapq.heapify(heap)
    codes, turn = dict.fromkeys(counts, ""), len(heap)
    while len(heap) > 1:
        (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        codes |= {k: "0" + codes[k] for k in a} | {k: "1" + codes[k] for k in b}
        heapq.heappush(heap, (wa + wb, turn, a + b))
        turn += 1
    return codes


def huffman_lengths(df: DataFrame, x: str) -> DataFrame:
    """Average code length of x under its Huffman code. The code table is as large as the alphabet, which must be small."""
    counts = {r[0]: r[1] for r in df.groupBy(x).count().collect()}
    codes = huffman(counts)
    total = sum(counts.values())
    return df.sparkSession.createDataFrame([(len(codes), sum(counts[k] * len(c) for k, c in codes.items()) / total)], "symbols int, average_length double")


def max_entropy(n: int, constraint: list[float], mean: float, rounds: int = 200) -> list[float]:
    """Distribution of greatest entropy over n outcomes with the given mean of `constraint`: exponential tilt found by bisection."""
    low, high = -50.0, 50.0
    for _ in range(rounds):
        lam = (low + high) / 2
        top = max(lam * c for c in constraint)
        w = [math.exp(lam * c - top) for c in constraint]
        got = sum(c * x for c, x in zip(constraint, w, strict=True)) / sum(w)
        low, high = (lam, high) if got < mean else (low, lam)
    return [x / sum(w) for x in w]
