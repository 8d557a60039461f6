"""Principal components, factorisations, embeddings and outlier scores from covariance aggregates or bounded kernels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import affinity, square_distances
from .linear import as_matrix, gram_columns


def covariance(df: DataFrame, x: list[str], ddof: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Means, covariance and n from one aggregate."""
    m = as_matrix(df.agg(*gram_columns(x)).first(), len(x) + 1)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return mean, (m[1:, 1:] - n * np.outer(mean, mean)) / (n - ddof), n


def pca(df: DataFrame, x: list[str], k: int) -> dict:
    """mean, components (rows, largest variance first, each component's largest entry positive), variances and their shares."""
    mean, cov, _ = covariance(df, x)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    comps = vectors[:, order[:k]].T
    comps = comps * np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])[:, None]
    return {"mean": mean, "components": comps, "variance": values[order[:k]], "share": values[order[:k]] / values.sum()}


def project(df: DataFrame, model: dict, x: list[str]) -> DataFrame:
    """Adds z0.. of centred rows."""
    parts = [sum((float(c) * (F.col(v) - float(m)) for v, c, m in zip(x, row, model["mean"], strict=True)), F.lit(0.0)) for row in model["components"]]
    return df.select("*", *(p.alias(f"z{i}") for i, p in enumerate(parts)))


def reconstruction_error(df: DataFrame, model: dict, x: list[str]) -> DataFrame:
    """Adds residual: squared length outside the components."""
    k = len(model["components"])
    total = sum((F.pow(F.col(v) - float(m), F.lit(2)) for v, m in zip(x, model["mean"], strict=True)), F.lit(0.0))
    inside = sum((F.pow(F.col(f"z{i}"), F.lit(2)) for i in range(k)), F.lit(0.0))
    return project(df, model, x).withColumn("residual", total - inside)


def mahalanobis_sq(df: DataFrame, x: list[str], reg: float = 1e-6) -> DataFrame:
    mean, cov, _ = covariance(df, x)
    inv = np.linalg.inv(cov + reg * np.eye(len(x)))
    z = [F.col(v) - float(m) for v, m in zip(x, mean, strict=True)]
    q: Column = sum((float(inv[i, j]) * z[i] * z[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    return df.withColumn("mahalanobis_sq", q)


def tall_qr(df: DataFrame, x: list[str]) -> np.ndarray:
    """R of a tall matrix: QR of each batch, then of the stacked R's (d x d each). Signs make the diagonal positive."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.empty((0, len(x)))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, b.to_numpy(float)]), mode="r")
        yield pd.DataFrame(r, columns=x)

    parts = df.select(*x).mapInPandas(local, ", ".join(f"{c} double" for c in x))
    # stack in steps, so that the driver sees one d x d matrix
    r = np.array(parts.repartition(1).mapInPandas(local, parts.schema).collect(), float)
    return r * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))[:, None]


def power_iteration(a: np.ndarray, rounds: int = 1000, tol: float = 1e-12) -> tuple[float, np.ndarray]:
    v = np.ones(len(a)) / math.sqrt(len(a))
    value = 0.0
    for _ in range(rounds):
        w = a @ v
        new = float(v @ w)
        v = w / np.linalg.norm(w)
        if abs(new - value) < tol * max(1, abs(new)):
            break
        value = new
    return new, v


def singular_values(df: DataFrame, x: list[str]) -> np.ndarray:
    return np.linalg.svd(tall_qr(df, x), compute_uv=False)


def rank_correlation(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Correlation of row numbers in each order; ties in the order of key."""
    from .ordered import numbered

    ranked = numbered(numbered(df.select(a, b, key), a, "ra", (key,)), b, "rb", (key,))
    return ranked.agg(F.corr("ra", "rb").alias("rank_correlation"))


def isomap(x: np.ndarray, k: int = 2, neighbours: int = 10) -> np.ndarray:
    """Shortest paths over the neighbour graph, then classical scaling."""
    d = np.where(affinity(x, None, neighbours) > 0, np.sqrt(square_distances(x)), np.inf)
    np.fill_diagonal(d, 0)
    for m in range(len(x)):
        d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1])
    d = np.where(np.isfinite(d), d, d[np.isfinite(d)].max())
    j = np.eye(len(x)) - 1 / len(x)
    values, vectors = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    at = np.argsort(-values)[:k]
    return vectors[:, at] * np.sqrt(np.maximum(values[at], 0))


def neighbour_probabilities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Row distributions of the given perplexity, by bisection on each precision."""
    n = len(d2)
    low, high = np.full(n, 1e-20), np.full(n, 1e20)
    beta = np.ones(n)
    off = ~np.eye(n, dtype=bool)
    for _ in range(100):
        e = np.exp(-(d2 - np.where(off, d2, np.inf).min(1, keepdims=True)) * beta[:, None]) * off
        p = e / e.sum(1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        over = h > math.log(perplexity)
        low, high = np.where(over, beta, low), np.where(over, high, beta)
        beta = np.where(high >= 1e20, beta * 2, np.where(low <= 1e-20, beta / 2, (low + high) / 2))
    return p


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 300, rate: float = 200.0, seed: int = 0) -> np.ndarray:
    n = len(x)
    p = neighbour_probabilities(square_distances(x), min(perplexity, (n - 1) / 3))
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(size=(n, 2)) * 1e-4
    move = np.zeros_like(y)
    for t in range(rounds):
        q = 1 / (1 + square_distances(y))
        np.fill_diagonal(q, 0)
        w = (p * (4 if t < 100 else 1) - np.maximum(q / q.sum(), 1e-12)) * q
        move = (0.5 if t < 250 else 0.8) * move - rate * 4 * (w.sum(1)[:, None] * y - w @ y)
        y = y + move
        y = y - y.mean(0)
    return y


def nmf(a: np.ndarray, k: int, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors by multiplicative updates."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((a.shape[0], k)) + 0.1, rng.random((k, a.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ a) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (a @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w, h


# --- isolation forest


def path_norm(n: int | float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_tree(x: np.ndarray, rng: np.random.Generator, limit: int, depth: int = 0) -> tuple:
    if depth >= limit or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return (len(x),)
    f = int(rng.choice(np.flatnonzero(x.max(0) > x.min(0))))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    return (f, cut, isolation_tree(x[x[:, f] < cut], rng, limit, depth + 1), isolation_tree(x[x[:, f] >= cut], rng, limit, depth + 1))


def path_lengths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + path_norm(tree[0]))
    out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[left], out[~left] = path_lengths(tree[2], x[left], depth + 1), path_lengths(tree[3], x[~left], depth + 1)
    return out


def isolation_scores(df: DataFrame, key: str, x: list[str], trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """key, score = 2^(-mean path / norm). Each tree sees the `sample` rows of smallest hash for it; the forest is small and broadcast."""
    draws = df.select(*x, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.col(key).alias("k"))
    n = df.count()
    share = min(1.0, 4 * sample / max(n, 1))
    h = F.xxhash64(F.lit(seed), "tree", "k")
    thin = draws.withColumn("h", h).where(F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) <= share)
    w = Window.partitionBy("tree").orderBy("h", "k")
    got = thin.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).select("tree", *x).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["tree"], []).append([r[c] for c in x])
    size = max(map(len, by.values()))
    forest = [isolation_tree(np.array(rows, float), np.random.default_rng([seed, t]), math.ceil(math.log2(max(size, 2)))) for t, rows in sorted(by.items())]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        m = np.stack([c.to_numpy(float) for c in cols], 1)
        return pd.Series(2.0 ** (-np.mean([path_lengths(t, m) for t in shared.value], axis=0) / path_norm(size)))

    return df.select(key, score(*x).alias("score"))
