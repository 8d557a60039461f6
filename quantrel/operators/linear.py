"""Linear, ridge, lasso, elastic-net and logistic models from second-moment aggregates.

One pass over the rows gives the moment matrix of [1, x, y]; every solver after that works on the driver with d x d numbers,
whatever the number of rows. Cross-validation takes one moment matrix a fold, and a training matrix is the total less the fold's.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantrel import functions as fn

from .statistics import f_tail, t_quantile, two_sided


def gram_columns(names: list[str], weight: Column | None = None) -> list[Column]:
    """Sums of products of all pairs of [1, *names], optionally weighted."""
    cols = [F.lit(1.0), *(F.col(n).cast("double") for n in names)]
    return [F.sum(cols[i] * cols[j] * (1.0 if weight is None else weight)).alias(f"m_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def as_matrix(row, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = row[f"m_{i}_{j}"] or 0.0
    return out


def gram(df: DataFrame, x: list[str], y: str, weight: Column | None = None) -> np.ndarray:
    return as_matrix(df.agg(*gram_columns([*x, y], weight)).first(), len(x) + 2)


def grams_by(df: DataFrame, x: list[str], y: str, fold: str) -> dict:
    return {r[fold]: as_matrix(r, len(x) + 2) for r in df.groupBy(fold).agg(*gram_columns([*x, y])).collect()}


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """XtX and Xty about the means, the means, n and the total sum of squares."""
    n, means = m[0, 0], m[0, 1:-1] / m[0, 0]
    ybar = m[0, -1] / n
    a = m[1:-1, 1:-1] - n * np.outer(means, means)
    b = m[1:-1, -1] - n * means * ybar
    return a, b, np.append(means, ybar), n, m[-1, -1] - n * ybar * ybar


def ols(df: DataFrame, x: list[str], y: str, alpha: float = 0.05) -> dict:
    """Coefficients (intercept first) with errors, t, p, intervals, R2, adjusted R2, F and the inverse moment matrix."""
    m = gram(df, x, y)
    inv = np.linalg.inv(m[:-1, :-1])
    beta = inv @ m[:-1, -1]
    n, k = m[0, 0], len(x)
    rss = m[-1, -1] - beta @ m[:-1, -1]
    tss = centred(m)[4]
    dof = n - k - 1
    se = np.sqrt(np.diag(inv) * rss / dof)
    t = beta / se
    half = t_quantile(1 - alpha / 2, dof) * se
    f = (tss - rss) / k / (rss / dof)
    return {"coef": beta, "se": se, "t": t, "p": [two_sided(v, dof) for v in t], "low": beta - half, "high": beta + half, "r2": 1 - rss / tss, "adjusted_r2": 1 - (rss / dof) / (tss / (n - 1)), "f": f, "f_p": f_tail(f, k, dof), "sigma2": rss / dof, "inverse": inv, "n": n}


def linear_predictor(x: list[str], coef) -> Column:
    return sum((float(c) * F.col(v) for c, v in zip(coef[1:], x, strict=True)), F.lit(float(coef[0])))


def diagnostics(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """Adds fitted, leverage, studentized and cooks_distance; the model is two small arrays in the plan."""
    r = ols(df, x, y)
    z = [F.lit(1.0), *(F.col(v).cast("double") for v in x)]
    lev = sum((float(r["inverse"][i, j]) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
    rows = df.withColumn("fitted", linear_predictor(x, r["coef"])).withColumn("leverage", lev)
    res, h = F.col(y) - F.col("fitted"), F.col("leverage")
    st = res / F.sqrt(F.lit(float(r["sigma2"])) * (1 - h))
    return rows.withColumn("studentized", st).withColumn("cooks_distance", st * st * h / ((1 - h) * len(z)))


def variance_inflation(df: DataFrame, x: list[str]) -> list[float]:
    """1 / (1 - R2) of each predictor on the others: the diagonal of the inverse correlation matrix."""
    a = centred(gram(df, x, x[0]))[0]
    s = np.sqrt(np.diag(a))
    return list(np.diag(np.linalg.inv(a / np.outer(s, s))))


def ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Minimises |y - Xw|^2 + alpha |w|^2, intercept free."""
    a, b, means, _, _ = centred(m)
    w = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    return np.append(means[-1] - means[:-1] @ w, w)


def effective_dof(m: np.ndarray, alpha: float) -> float:
    values = np.linalg.eigvalsh(centred(m)[0])
    return float((values / (values + alpha)).sum())


def elastic_net(m: np.ndarray, alpha: float, l1_ratio: float = 1.0, start: np.ndarray | None = None, rounds: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Minimises |y - Xw|^2 / 2n + alpha (r |w|_1 + (1 - r) |w|^2 / 2) by coordinate descent on the moments."""
    a, b, means, n, _ = centred(m)
    a, b = a / n, b / n
    w = np.zeros(len(b)) if start is None else start.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            new = math.copysign(max(abs(rho) - alpha * l1_ratio, 0.0), rho) / (a[j, j] + alpha * (1 - l1_ratio))
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    return np.append(means[-1] - means[:-1] @ w, w)


def lasso_proximal(m: np.ndarray, alpha: float, rounds: int = 5000, tol: float = 1e-14) -> np.ndarray:
    """The lasso by proximal gradient steps of 1 / largest eigenvalue."""
    a, b, means, n, _ = centred(m)
    a, b = a / n, b / n
    step = 1 / np.linalg.eigvalsh(a)[-1]
    w = np.zeros(len(b))
    for _ in range(rounds):
        g = w - step * (a @ w - b)
        new = np.sign(g) * np.maximum(np.abs(g) - step * alpha, 0)
        if np.abs(new - w).max() < tol:
            break
        w = new
    return np.append(means[-1] - means[:-1] @ w, w)


def path(m: np.ndarray, alphas: list[float], l1_ratio: float = 1.0) -> list[tuple[float, np.ndarray]]:
    """Coefficients over falling alphas, each started from the last."""
    out, w = [], None
    for a in sorted(alphas, reverse=True):
        coef = elastic_net(m, a, l1_ratio, w)
        w = coef[1:]
        out.append((a, coef))
    return out


def squared_error(m: np.ndarray, coef: np.ndarray) -> float:
    v = np.append(coef, -1.0)
    return float(v @ m @ v)


def cross_validate(df: DataFrame, x: list[str], y: str, fold: str, alphas: list[float], fit=ridge) -> dict:
    """Mean squared error of each alpha over folds, the best alpha, and the largest within one standard error of it."""
    folds = grams_by(df, x, y, fold)
    total = sum(folds.values())
    table = {}
    for a in alphas:
        e = np.array([squared_error(m, fit(total - m, a)) / m[0, 0] for m in folds.values()])
        table[a] = (float(e.mean()), float(e.std(ddof=1) / math.sqrt(len(e))))
    best = min(table, key=lambda a: table[a][0])
    return {"errors": table, "best": best, "one_se": max(a for a in alphas if table[a][0] <= table[best][0] + table[best][1])}


def logistic(df: DataFrame, x: list[str], y: str, lam: float = 0.0, rounds: int = 50, tol: float = 1e-10) -> dict:
    """Newton steps for mean log-loss + lam / 2n |w|^2; each step is one aggregate of gradient and Hessian."""
    d = len(x) + 1
    z = [F.lit(1.0), *(F.col(v).cast("double") for v in x)]
    rows = df.select(*x, F.col(y).cast("double").alias("__y"))
    w = np.zeros(d)
    for _ in range(rounds):
        p = fn.sigmoid(linear_predictor(x, w))
        aggs = [F.sum((p - F.col("__y")) * z[i]).alias(f"g_{i}") for i in range(d)]
        aggs += [F.sum(p * (1 - p) * z[i] * z[j]).alias(f"m_{i}_{j}") for i in range(d) for j in range(i, d)]
        r = rows.agg(*aggs).first()
        penalty = lam * np.append(0.0, w[1:])
        h = as_matrix(r, d) + lam * np.diag([0.0] + [1.0] * (d - 1))
        step = np.linalg.solve(h, np.array([r[f"g_{i}"] for i in range(d)]) + penalty)
        w = w - step
        if np.abs(step).max() < tol:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    return {"coef": w, "se": se, "odds_ratio": np.exp(w), "low": np.exp(w - 1.959963984540054 * se), "high": np.exp(w + 1.959963984540054 * se)}


def softmax_regression(df: DataFrame, x: list[str], y: str, classes: list, lam: float = 1e-4, lr: float = 0.5, rounds: int = 100) -> np.ndarray:
    """Full-batch gradient descent on mean cross-entropy + lam / 2 |W|^2; a step is one aggregate. Rows: classes; columns: 1, x."""
    d, k = len(x) + 1, len(classes)
    z = [F.lit(1.0), *(F.col(v).cast("double") for v in x)]
    w = np.zeros((k, d))
    for _ in range(rounds):
        logits = F.array(*(linear_predictor(x, w[c]) for c in range(k)))
        rows = df.select(*x, y, fn.softmax(logits).alias("__p"))
        r = rows.agg(*(F.avg((F.get("__p", F.lit(c)) - (F.col(y) == classes[c]).cast("double")) * z[j]).alias(f"g_{c}_{j}") for c in range(k) for j in range(d))).first()
        g = np.array([[r[f"g_{c}_{j}"] for j in range(d)] for c in range(k)])
        g[:, 1:] += lam * w[:, 1:]
        w = w - lr * g
    return w


def project_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point with non-negative entries that sum to 1."""
    u = np.sort(v)[::-1]
    theta = (u.cumsum() - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - theta[np.nonzero(u > theta)[0][-1]], 0)


def simplex_blend(m: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Weights on the simplex that minimise |y - Xw|^2: a blend of base models."""
    a, b = m[1:-1, 1:-1], m[1:-1, -1]
    step = 1 / np.linalg.eigvalsh(a)[-1]
    w = np.full(len(b), 1 / len(b))
    for _ in range(rounds):
        w = project_simplex(w - step * (a @ w - b))
    return w


def platt(df: DataFrame, score: str, y: str) -> dict:
    return logistic(df, [score], y)


def temperature(df: DataFrame, logit: str, y: str, rounds: int = 60) -> float:
    """Scale T that minimises log-loss of sigmoid(logit / T), by Newton steps on 1 / T: each is one aggregate."""
    b = 1.0
    z, t = F.col(logit).cast("double"), F.col(y).cast("double")
    for _ in range(rounds):
        p = fn.sigmoid(z * b)
        r = df.agg(F.avg((p - t) * z).alias("g"), F.avg(p * (1 - p) * z * z).alias("h")).first()
        step = r["g"] / max(r["h"], 1e-12)
        b = max(1e-3, b - max(-1.0, min(1.0, step)))
        if abs(step) < 1e-10:
            break
    return 1 / b


# --- bases


def polynomial_basis(x: str, degree: int) -> list[Column]:
    return [F.pow(F.col(x), F.lit(k)).alias(f"p{k}") for k in range(1, degree + 1)]


def legendre_basis(x: str, degree: int, low: float, high: float) -> list[Column]:
    """Legendre polynomials 1.. of x mapped to [-1, 1], by the three-term recurrence."""
    u = 2 * (F.col(x) - low) / (high - low) - 1
    rows = [F.lit(1.0), u]
    for k in range(1, degree):
        rows.append(((2 * k + 1) * u * rows[k] - k * rows[k - 1]) / (k + 1))
    return [c.alias(f"q{k}") for k, c in enumerate(rows[1 : degree + 1], 1)]


def truncated_power_basis(x: str, knots: list[float], degree: int = 3) -> list[Column]:
    return [*polynomial_basis(x, degree), *(F.pow(F.greatest(F.col(x) - k, F.lit(0.0)), F.lit(degree)).alias(f"t{i}") for i, k in enumerate(knots))]


def natural_cubic_basis(x: str, knots: list[float]) -> list[Column]:
    """x and K - 2 cubic pieces that are linear beyond the outer knots."""
    cube = lambda k: F.pow(F.greatest(F.col(x) - k, F.lit(0.0)), F.lit(3))
    last = knots[-1]
    d = [(cube(k) - cube(last)) / (last - k) for k in knots[:-1]]
    return [F.col(x).cast("double").alias("n0"), *((v - d[-1]).alias(f"n{i + 1}") for i, v in enumerate(d[:-1]))]


def bspline_basis(x: str, inner: list[float], low: float, high: float, degree: int = 3) -> list[Column]:
    """Clamped B-splines by the Cox-de Boor recursion; the last interval is closed."""
    t = [low] * (degree + 1) + list(inner) + [high] * (degree + 1)
    v = F.col(x)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    rows = [F.when((v >= t[i]) & ((v < t[i + 1]) | ((v == high) if i == last else F.lit(False))), 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
    for p in range(1, degree + 1):
        part = lambda i, a, b, own: own * a / b if b else F.lit(0.0)
        rows = [part(i, v - t[i], t[i + p] - t[i], rows[i]) + part(i, t[i + p + 1] - v, t[i + p + 1] - t[i + 1], rows[i + 1]) for i in range(len(rows) - 1)]
    return [c.alias(f"b{i}") for i, c in enumerate(rows)]


def spline_fit(df: DataFrame, x: str, y: str, knots: int = 5) -> tuple[list[Column], np.ndarray]:
    """Least squares in natural cubic splines with knots at exact percentiles."""
    at = df.agg(F.percentile(x, [(i + 1) / (knots + 1) for i in range(knots)])).first()[0]
    basis = natural_cubic_basis(x, at)
    names = [f"n{i}" for i in range(len(basis))]
    return basis, ols(df.select(y, *basis), names, y)["coef"]


def additive_fit(df: DataFrame, x: list[str], y: str, knots: int = 5) -> np.ndarray:
    """Additive model of natural splines. All bases enter one moment matrix, whose solution is where backfitting converges."""
    cols, names = [], []
    for v in x:
        at = df.agg(F.percentile(v, [(i + 1) / (knots + 1) for i in range(knots)])).first()[0]
        for b, c in enumerate(natural_cubic_basis(v, at)):
            cols.append(c.alias(f"{v}_{b}"))
            names.append(f"{v}_{b}")
    return ridge(gram(df.select(y, *cols), names, y), 1e-9)


def curvature_penalty(knots: list[float]) -> np.ndarray:
    """Integrals of products of second derivatives of the natural cubic basis, exact by two-point Gauss rules between knots."""
    k, last = len(knots), knots[-1]

    def second(v: np.ndarray) -> np.ndarray:
        part = lambda t: 6 * np.maximum(v - t, 0)
        d = [(part(t) - part(last)) / (last - t) for t in knots[:-1]]
        return np.array([np.zeros_like(v), *(x - d[-1] for x in d[:-1])])

    out = np.zeros((k - 1, k - 1))
    for a, b in zip(knots, knots[1:], strict=False):
        half = (b - a) / 2
        v = second((a + b) / 2 + half / math.sqrt(3) * np.array([-1.0, 1.0]))
        out += half * v @ v.T
    return out


def smoothing_spline(df: DataFrame, x: str, y: str, knots: int = 10, lambdas: list[float] | None = None) -> dict:
    """Natural splines with a curvature penalty; the penalty of least generalised cross-validation error. One aggregate, then driver algebra."""
    at = df.agg(F.percentile(x, [i / (knots - 1) for i in range(knots)])).first()[0]
    basis = natural_cubic_basis(x, at)
    names = [f"n{i}" for i in range(len(basis))]
    m = gram(df.select(y, *basis), names, y)
    omega = np.zeros((len(names) + 1, len(names) + 1))
    omega[1:, 1:] = curvature_penalty(at)
    g, b, n = m[:-1, :-1], m[:-1, -1], m[0, 0]
    best = None
    for lam in lambdas or [10.0**e for e in range(-8, 9)]:
        inverse = np.linalg.pinv(g + lam * omega)
        coef = inverse @ b
        dof = float(np.trace(inverse @ g))
        error = squared_error(m, coef) / n / max(1 - dof / n, 1e-9) ** 2
        if best is None or error < best["gcv"]:
            best = {"lambda": lam, "gcv": error, "dof": dof, "coef": coef, "knots": at}
    return best


def stack(df: DataFrame, models: dict[str, list[str]], y: str, fold: str, alpha: float = 1.0) -> dict:
    """Out-of-fold ridge predictions of each model (name -> its columns), their blend on the simplex, and the models refitted on all rows.

    Each model needs one moment matrix a fold; the blend needs one more pass over the out-of-fold columns.
    """
    columns, final = [], {}
    for name, x in models.items():
        folds = grams_by(df, x, y, fold)
        total = sum(folds.values())
        case = F
        for k, m in folds.items():
            case = case.when(F.col(fold) == k, linear_predictor(x, ridge(total - m, alpha)))
        columns.append(case.alias(f"oof_{name}"))
        final[name] = ridge(total, alpha)
    names = [f"oof_{n}" for n in models]
    weights = simplex_blend(gram(df.select(y, *columns), names, y))
    return {"weights": dict(zip(models, weights, strict=True)), "models": final}
