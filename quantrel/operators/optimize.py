"""Descent methods over objectives whose value and gradient may each be a Spark aggregate, and searches over settings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantrel import functions as fn

from .linear import linear_predictor

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def logistic_objective(df: DataFrame, x: list[str], y: str, l2: float = 0.01) -> Objective:
    """Mean log-loss with a ridge: value and gradient come from one aggregate over the rows."""
    rows = df.select(*x, F.col(y).cast("double").alias("__y"))
    z = [F.lit(1.0), *(F.col(v).cast("double") for v in x)]

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = linear_predictor(x, w)
        gap = fn.sigmoid(s) - F.col("__y")
        r = rows.agg(F.avg(fn.bce_with_logits(s, F.col("__y"))).alias("v"), *(F.avg(gap * c).alias(f"g{i}") for i, c in enumerate(z))).first()
        return r["v"] + 0.5 * l2 * float(w @ w), np.array([r[f"g{i}"] for i in range(len(z))]) + l2 * w

    return f


def numerical_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    steps = h * np.eye(len(x))
    return np.array([(f(x + s) - f(x - s)) / (2 * h) for s in steps])


def gradient_error(f: Objective, x: np.ndarray, h: float = 1e-5) -> float:
    """Largest relative gap between the gradient and central differences."""
    a, b = f(x)[1], numerical_gradient(lambda v: f(v)[0], x, h)
    return float(np.max(np.abs(a - b) / np.maximum(1e-8, np.abs(a) + np.abs(b))))


def armijo(f: Objective, x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, start: float = 1.0, c: float = 1e-4, shrink: float = 0.5) -> float:
    """First step of a shrinking row that lowers the value by c * step * slope."""
    slope, step = float(grad @ direction), start
    for _ in range(60):
        if f(x + step * direction)[0] <= value + c * step * slope:
            break
        step *= shrink
    return step


def wolfe(f: Objective, x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, c1: float = 1e-4, c2: float = 0.9) -> float:
    """Bisection for a step that meets the decrease and the curvature conditions."""
    slope, low, high, step = float(grad @ direction), 0.0, math.inf, 1.0
    for _ in range(60):
        v, g = f(x + step * direction)
        if v > value + c1 * step * slope:
            high = step
        elif float(g @ direction) < c2 * slope:
            low = step
        else:
            break
        step = (low + high) / 2 if high < math.inf else 2 * low
    return step


class Stepper:
    """Keeps what a first-order rule remembers and turns gradients into moves."""

    RULES = ("sgd", "momentum", "nesterov", "adagrad", "rmsprop", "adam")

    def __init__(self, rule: str = "adam", rate: float = 0.01, beta: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        if rule not in self.RULES:
            raise ValueError(rule)
        self.rule, self.rate, self.beta, self.beta2, self.eps, self.t = rule, rate, beta, beta2, eps, 0
        self.first = self.second = 0.0

    def move(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        if self.rule == "sgd":
            return -self.rate * g
        if self.rule in ("momentum", "nesterov"):
            self.first = self.beta * self.first - self.rate * g
            return self.first if self.rule == "momentum" else self.beta * self.first - self.rate * g
        if self.rule == "adagrad":
            self.second = self.second + g * g
            return -self.rate * g / (np.sqrt(self.second) + self.eps)
        if self.rule == "rmsprop":
            self.second = self.beta * self.second + (1 - self.beta) * g * g
            return -self.rate * g / (np.sqrt(self.second) + self.eps)
        self.first = self.beta * self.first + (1 - self.beta) * g
        self.second = self.beta2 * self.second + (1 - self.beta2) * g * g
        return -self.rate * (self.first / (1 - self.beta**self.t)) / (np.sqrt(self.second / (1 - self.beta2**self.t)) + self.eps)


def descend(f: Objective, x: np.ndarray, stepper: Stepper, rounds: int = 1000, tol: float = 1e-8) -> tuple[np.ndarray, list[float]]:
    x, seen = np.array(x, float), []
    for _ in range(rounds):
        v, g = f(x)
        seen.append(v)
        if np.linalg.norm(g) < tol:
            break
        x = x + stepper.move(g)
    return x, seen


def newton(f: Objective, hessian: Callable[[np.ndarray], np.ndarray], x: np.ndarray, rounds: int = 100, tol: float = 1e-10, damping: float = 1e-8) -> np.ndarray:
    x = np.array(x, float)
    for _ in range(rounds):
        v, g = f(x)
        if np.linalg.norm(g) < tol:
            break
        d = -np.linalg.solve(hessian(x) + damping * np.eye(len(x)), g)
        if g @ d > 0:
            d = -g
        x = x + armijo(f, x, v, g, d) * d
    return x


def lbfgs(f: Objective, x: np.ndarray, memory: int = 10, rounds: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Two-loop recursion over the last `memory` moves; memory None keeps all, which is BFGS."""
    x = np.array(x, float)
    v, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(g) < tol:
            break
        q, held = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            q -= a * y
            held.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(held), strict=True):
            q += (a - y @ q / (y @ s)) * s
        step = wolfe(f, x, v, g, -q)
        new = x - step * q
        nv, ng = f(new)
        if (new - x) @ (ng - g) > 1e-14:
            pairs.append((new - x, ng - g))
            pairs = pairs[-memory:] if memory else pairs
        x, v, g = new, nv, ng
    return x


def quadratic(h: np.ndarray, b: np.ndarray) -> Objective:
    return lambda x: (float(0.5 * x @ h @ x - b @ x), h @ x - b)


def rosenbrock(a: float = 1.0, b: float = 100.0) -> Objective:
    return lambda x: (float((a - x[0]) ** 2 + b * (x[1] - x[0] ** 2) ** 2), np.array([-2 * (a - x[0]) - 4 * b * x[0] * (x[1] - x[0] ** 2), 2 * b * (x[1] - x[0] ** 2)]))


# --- searches


def grid_search(evaluate: Callable[[dict], float], grid: dict[str, list]) -> tuple[dict, float]:
    """Best setting of a full grid; the first on ties."""
    best = None
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        score = evaluate(params)
        if best is None or score > best[1]:
            best = (params, score)
    return best


def random_search(evaluate: Callable[[dict], float], samplers: dict[str, Callable], rounds: int, seed: int = 0) -> tuple[dict, list[float]]:
    """Best setting and the best score so far after each round."""
    rng, best, curve, found = np.random.default_rng(seed), -math.inf, [], {}
    for _ in range(rounds):
        params = {k: s(rng) for k, s in samplers.items()}
        score = evaluate(params)
        if score > best:
            best, found = score, params
        curve.append(best)
    return found, curve


def successive_halving(configs: list, evaluate: Callable, budgets: list[int], keep: float = 0.5) -> tuple[object, int]:
    """Best config after rungs of rising budget, and what all evaluations cost."""
    cost = 0
    for budget in budgets:
        scored = sorted(((evaluate(c, budget), -i) for i, c in enumerate(configs)), reverse=True)
        cost += budget * len(configs)
        configs = [configs[-i] for _, i in scored[: max(1, int(len(configs) * keep))]]
    return configs[0], cost


class GaussianProcess:
    """RBF posterior over standardised values, for tens of points."""

    def __init__(self, length: float = 0.2, signal: float = 1.0, noise: float = 1e-4):
        self.length, self.signal, self.noise = length, signal, noise

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
        return self.signal * np.exp(-0.5 * d2 / self.length**2)

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.mean, self.scale = x, y.mean(), y.std() or 1.0
        self.factor = np.linalg.cholesky(self.kernel(x, x) + self.noise * np.eye(len(x)))
        self.alpha = np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, (y - self.mean) / self.scale))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.kernel(x, self.x)
        v = np.linalg.solve(self.factor, k.T)
        return k @ self.alpha * self.scale + self.mean, np.sqrt(np.maximum(self.signal - (v * v).sum(0), 1e-12)) * self.scale


def expected_improvement(mean: np.ndarray, sd: np.ndarray, best: float, margin: float = 0.01) -> np.ndarray:
    """For minimisation."""
    z = (best - mean - margin) / sd
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    return (best - mean - margin) * cdf + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def bayes_optimize(objective: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray, start: int = 4, rounds: int = 20, seed: int = 0, candidates: int = 2000) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    draw = lambda n: low + (high - low) * rng.random((n, len(low)))
    x = draw(start)
    y = np.array([objective(v) for v in x])
    for _ in range(rounds):
        unit = (x - low) / (high - low)
        near = draw(candidates)
        mean, sd = GaussianProcess().fit(unit, y).predict((near - low) / (high - low))
        new = near[np.argmax(expected_improvement(mean, sd, y.min()))]
        x, y = np.vstack([x, new]), np.append(y, objective(new))
    return x[y.argmin()], float(y.min())
