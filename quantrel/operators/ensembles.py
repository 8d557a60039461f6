"""An estimator contract, and what is built on any estimator that keeps it: cross-validation, bagging with out-of-bag scores, blending.

An estimator has fit(df, weight=None), which returns a model; a model has predict(df, out), which adds a column. Fitting is a
few aggregates over df, so a model is small and lives on the driver; predicting is an expression over a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantrel import functions as fn


class Model(Protocol):
    def predict(self, df: DataFrame, out: str) -> DataFrame: ...


class Estimator(Protocol):
    def fit(self, df: DataFrame, weight: str | None = None) -> Model: ...


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coef: np.ndarray

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        terms = [F.lit(float(c)) * F.col(f) for c, f in zip(self.coef[1:], self.features, strict=True)]
        return df.withColumn(out, reduce(Column.__add__, terms, F.lit(float(self.coef[0]))))


@dataclass(frozen=True)
class Linear:
    """Weighted least squares with a ridge on the slopes: one aggregate of second moments."""

    features: tuple[str, ...]
    y: str
    lam: float = 0.0

    def fit(self, df: DataFrame, weight: str | None = None) -> LinearModel:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        x = [F.lit(1.0), *(F.col(f).cast("double") for f in self.features), F.col(self.y).cast("double")]
        n = len(x)
        row = df.agg(*(F.sum(w * x[i] * x[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n))).first()
        m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], float)
        ridge = self.lam * np.diag([0.0] + [1.0] * (n - 2))
        return LinearModel(self.features, np.linalg.lstsq(m[:-1, :-1] + ridge, m[:-1, -1], rcond=None)[0])


def r2_score(y: str) -> Callable[[DataFrame, str], float]:
    """A score_fn: 1 - squared error / variance around the scored rows' own mean."""

    def score(df: DataFrame, p: str) -> float:
        e, v = df.agg(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2))), F.var_pop(y)).first()
        return 1 - e / v if v else float("nan")

    return score


def cross_val_score(df: DataFrame, fold: str, folds: list[int], make_model: Callable[[], Estimator], score_fn: Callable[[DataFrame, str], float]) -> list[float]:
    """The score of each fold's rows by a model of all the others."""
    return [score_fn(make_model().fit(df.where(F.col(fold) != k)).predict(df.where(F.col(fold) == k), "__p"), "__p") for k in folds]


def poisson_weight(u: Column) -> Column:
    """Poisson(1) by inversion, cut off at 8 (probability 1e-6): a row's copies in a bootstrap sample of a large table."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return reduce(Column.__add__, ((u >= F.lit(float(s))).cast("int") for s in steps))


def bag(df: DataFrame, make_model: Callable[[], Estimator], rounds: int, *keys: str) -> list[Model]:
    """A model of each of `rounds` bootstrap samples, drawn by the hash of the keys, so that a row's copies can be told again."""
    return [make_model().fit(df.withColumn("__w", copies(b, *keys)), "__w") for b in range(rounds)]


def copies(b: int, *keys: str) -> Column:
    return poisson_weight(fn.hashed_uniform(F.lit("bag"), F.lit(b), *map(F.col, keys)))


def bagged(df: DataFrame, models: list[Model], out: str, *keys: str) -> DataFrame:
    """Adds out (mean prediction), {out}_oob (mean over the models whose sample lacks the row, null if none does)."""
    parts = [f"__p{b}" for b in range(len(models))]
    for p, m in zip(parts, models, strict=True):
        df = m.predict(df, p)
    left = [(copies(b, *keys) == 0).cast("int") for b in range(len(models))]
    total = reduce(Column.__add__, (F.col(p) for p in parts)) / len(parts)
    held = reduce(Column.__add__, (F.when(x == 1, F.col(p)).otherwise(0.0) for x, p in zip(left, parts, strict=True)))
    return df.withColumn(out, total).withColumn(f"{out}_oob", fn.ratio(held, reduce(Column.__add__, left))).drop(*parts)


def blend(df: DataFrame, held_out: Column, bases: list[Estimator], meta: Callable[[tuple[str, ...]], Estimator]) -> Callable[[DataFrame, str], DataFrame]:
    """Bases are fitted on the other rows, the meta model on their predictions of the held-out rows; returns predict(df, out)."""
    models = [b.fit(df.where(~held_out)) for b in bases]
    names = tuple(f"__b{i}" for i in range(len(bases)))
    stack = lambda d: reduce(lambda x, nm: nm[1].predict(x, nm[0]), zip(names, models, strict=True), d)
    top = meta(names).fit(stack(df.where(held_out)))
    return lambda d, out: top.predict(stack(d), out).drop(*names)
