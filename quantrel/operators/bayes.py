"""Generative classifiers: class moments and token counts, joined back to score."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import as_matrix, gram_columns


def gaussian_parameters(df: DataFrame, x: list[str], y: str, smoothing: float = 1e-9) -> DataFrame:
    """y, prior, and mean and variance (ddof 0, plus smoothing times the largest overall variance) of each feature."""
    top = df.agg(F.greatest(*(F.var_pop(c) for c in x), F.lit(0.0)).alias("__top"))
    rows = df.groupBy(y).agg(F.count(F.lit(1)).alias("__n"), *(F.avg(c).alias(f"mean_{c}") for c in x), *(F.var_pop(c).alias(f"var_{c}") for c in x))
    prior = F.col("__n") / F.sum("__n").over(Window.partitionBy())
    return rows.join(F.broadcast(top)).select(y, prior.alias("prior"), *(f"mean_{c}" for c in x), *((F.col(f"var_{c}") + smoothing * F.col("__top")).alias(f"var_{c}") for c in x))


def gaussian_predict(df: DataFrame, params: DataFrame, x: list[str], y: str, key: str) -> DataFrame:
    """key, predicted (smallest class on ties) and its log-joint. One row a class is broadcast."""
    p = params.withColumnRenamed(y, "__class")
    logs = sum((-0.5 * (F.ln(2 * math.pi * F.col(f"var_{c}")) + F.pow(F.col(c) - F.col(f"mean_{c}"), F.lit(2)) / F.col(f"var_{c}")) for c in x), F.ln("prior"))
    both = df.join(F.broadcast(p)).withColumn("__log", logs)
    best = both.groupBy(key).agg(F.min(F.struct((-F.col("__log")).alias("a"), F.col("__class").alias("c"))).alias("b"))
    return best.select(key, F.col("b.c").alias("predicted"), (-F.col("b.a")).alias("log_joint"))


def tokens(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    return df.select(key, *keep, F.explode(F.split(F.trim(F.lower(text)), r"\s+")).alias("tok")).where("tok <> ''")


def multinomial_parameters(toks: DataFrame, y: str, alpha: float = 1.0) -> DataFrame:
    """tok, y, log_likelihood with add-alpha over the whole vocabulary."""
    n = toks.groupBy("tok", y).agg(F.count(F.lit(1)).alias("n"))
    classes = n.groupBy(y).agg(F.sum("n").alias("total"))
    vocabulary = n.select("tok").distinct()
    size = vocabulary.agg(F.count("tok").alias("size"))
    grid = vocabulary.join(F.broadcast(classes.join(F.broadcast(size))))
    full = grid.join(n, ["tok", y], "left")
    return full.select("tok", y, F.coalesce("n", F.lit(0)).alias("n"), F.ln((F.coalesce("n", F.lit(0)) + alpha) / (F.col("total") + alpha * F.col("size"))).alias("log_likelihood"))


def multinomial_predict(toks: DataFrame, params: DataFrame, priors: DataFrame, key: str, y: str) -> DataFrame:
    """key, predicted: token log-likelihoods joined by token and summed; priors (y, log_prior) are one row a class."""
    tf = toks.groupBy(key, "tok").agg(F.count(F.lit(1)).alias("tf"))
    p = params.select("tok", F.col(y).alias("c"), "log_likelihood")
    logs = tf.join(p, "tok").groupBy(key, "c").agg(F.sum(F.col("tf") * F.col("log_likelihood")).alias("l"))
    logs = logs.join(F.broadcast(priors.select(F.col(y).alias("c"), "log_prior")), "c").withColumn("l", F.col("l") + F.col("log_prior"))
    return logs.groupBy(key).agg(F.min(F.struct((-F.col("l")).alias("a"), "c")).alias("b")).select(key, F.col("b.c").alias("predicted"), (-F.col("b.a")).alias("log_joint"))


def bernoulli_predict(toks: DataFrame, docs: DataFrame, key: str, y: str, alpha: float = 1.0) -> DataFrame:
    """key, predicted by presence alone: the score of an empty document plus what each present token changes."""
    present = toks.select(key, y, "tok").distinct()
    classes = docs.groupBy(y).agg(F.count(F.lit(1)).alias("docs"))
    n = present.groupBy("tok", y).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("tok").distinct().join(F.broadcast(classes)).join(n, ["tok", y], "left")
    theta = (F.coalesce("n", F.lit(0)) + alpha) / (F.col("docs") + 2 * alpha)
    grid = grid.select("tok", F.col(y).alias("c"), theta.alias("t"))
    empty = grid.groupBy("c").agg(F.sum(F.ln(1 - F.col("t"))).alias("base"))
    total = classes.agg(F.sum("docs").alias("all_docs"))
    prior = classes.join(F.broadcast(total)).select(F.col(y).alias("c"), F.ln(F.col("docs") / F.col("all_docs")).alias("lp"))
    delta = present.select(key, "tok").join(grid, "tok").groupBy(key, "c").agg(F.sum(F.ln(F.col("t")) - F.ln(1 - F.col("t"))).alias("d"))
    score = delta.join(F.broadcast(empty.join(prior, "c")), "c").withColumn("l", F.col("d") + F.col("base") + F.col("lp"))
    return score.groupBy(key).agg(F.min(F.struct((-F.col("l")).alias("a"), "c")).alias("b")).select(key, F.col("b.c").alias("predicted"), (-F.col("b.a")).alias("log_joint"))


def class_moments(df: DataFrame, x: list[str], y: str) -> dict:
    """class -> (n, means, scatter about the mean) from one aggregate."""
    out = {}
    for r in df.groupBy(y).agg(*gram_columns(x)).collect():
        m = as_matrix(r, len(x) + 1)
        mean = m[0, 1:] / m[0, 0]
        out[r[y]] = (m[0, 0], mean, m[1:, 1:] - m[0, 0] * np.outer(mean, mean))
    return dict(sorted(out.items()))


def discriminant(df: DataFrame, x: list[str], y: str, gamma: float = 0.0, reg: float = 1e-6) -> dict:
    """class -> (log prior, mean, covariance): gamma 1 is quadratic, 0 linear (pooled), between is regularised."""
    parts = class_moments(df, x, y)
    n = sum(p[0] for p in parts.values())
    pooled = sum(p[2] for p in parts.values()) / (n - len(parts))
    eye = reg * np.eye(len(x))
    return {c: (math.log(k / n), mean, gamma * s / max(k - 1, 1) + (1 - gamma) * pooled + eye) for c, (k, mean, s) in parts.items()}


def discriminant_predict(df: DataFrame, model: dict, x: list[str], key: str) -> DataFrame:
    """key, predicted: log-joints as column expressions over the small model."""
    scores = []
    for c, (lp, mean, cov) in model.items():
        inv, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        z = [F.col(v) - float(a) for v, a in zip(x, mean, strict=True)]
        q = sum((float(inv[i, j]) * z[i] * z[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
        scores.append(F.struct((0.5 * q + 0.5 * float(logdet) - lp).alias("a"), F.lit(c).alias("c")))
    return df.select(key, F.array_min(F.array(*scores)).alias("b")).select(key, F.col("b.c").alias("predicted"), (-F.col("b.a")).alias("log_joint"))


def fisher_directions(df: DataFrame, x: list[str], y: str, k: int = 2) -> np.ndarray:
    """Directions that part the class means most against the pooled scatter."""
    parts = class_moments(df, x, y)
    n = sum(p[0] for p in parts.values())
    grand = sum(p[0] * p[1] for p in parts.values()) / n
    within = sum(p[2] for p in parts.values()) + 1e-9 * np.eye(len(x))
    between = sum(p[0] * np.outer(p[1] - grand, p[1] - grand) for p in parts.values())
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    return np.real(vectors[:, np.argsort(-np.real(values))[:k]])
