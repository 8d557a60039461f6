"""Column functions: stable numerics, activations, losses, vectors, closed-form distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ERF_TERMS = 40


def col(x: str | Column | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b in doubles; `otherwise` (or null) where b is 0."""
    safe = F.when(b != 0, a.cast("double") / b.cast("double"))
    return safe if otherwise is None else F.coalesce(safe, F.lit(otherwise))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def hashed_uniform(*keys: Column) -> Column:
    """A uniform in [0, 1) from the MD5 of the keys joined by colons: 48 bits, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys)).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def box_muller(u1: Column, u2: Column) -> Column:
    """A standard normal from two uniforms."""
    return F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * math.pi * u2)


def is_finite(x: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


# --- stable primitives and activations


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def relu(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0))


def leaky_relu(z: Column, a: float = 0.01) -> Column:
    return F.when(z > 0, z).otherwise(a * z)


def elu(z: Column, a: float = 1.0) -> Column:
    return F.when(z > 0, z).otherwise(a * F.expm1(F.least(z, F.lit(0.0))))


def swish(z: Column) -> Column:
    return z * sigmoid(z)


def erf(x: Column) -> Column:
    """Error function by its alternating-free series on |x| < 4, 1 beyond; within 1e-9."""
    z = F.least(F.abs(x), F.lit(4.0))
    # exp(-z^2) * sum 2^n z^(2n+1) / (2n+1)!! has positive terms only
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS * 2)), F.struct(z.alias("t"), z.alias("s")), lambda a, n: F.struct((a["t"] * 2 * z * z / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * n + 1)).alias("s")))
    return F.signum(x) * F.when(F.abs(x) >= 4, 1.0).otherwise(2 / math.sqrt(math.pi) * F.exp(-z * z) * terms["s"])


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def gelu(z: Column) -> Column:
    return z * normal_cdf(z)


def d_sigmoid(z: Column) -> Column:
    return sigmoid(z) * (1 - sigmoid(z))


def d_tanh(z: Column) -> Column:
    return 1 - F.tanh(z) * F.tanh(z)


def d_relu(z: Column) -> Column:
    return F.when(z > 0, 1.0).otherwise(0.0)


def d_leaky_relu(z: Column, a: float = 0.01) -> Column:
    return F.when(z > 0, 1.0).otherwise(a)


def soft_threshold(v: Column, t: float) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - F.lit(float(t)), F.lit(0.0))


def huber(r: Column, delta: float = 1.0) -> Column:
    low = F.least(F.abs(r), F.lit(float(delta)))
    return 0.5 * low * low + delta * (F.abs(r) - low)


def pinball(r: Column, tau: float = 0.5) -> Column:
    return F.greatest(tau * r, (tau - 1) * r)


def focal(p: Column, y: Column, gamma: float = 2.0) -> Column:
    """-(1 - p_t)^gamma ln p_t."""
    pt = F.when(y == 1, p).otherwise(1 - p)
    return -F.pow(1 - pt, F.lit(gamma)) * F.ln(pt)


# --- arrays as vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + floor)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(array_sum(F.transform(gap, lambda x: x * x)))
    if metric == "sqeuclidean":
        return array_sum(F.transform(gap, lambda x: x * x))
    if metric == "manhattan":
        return array_sum(gap)
    if metric == "chebyshev":
        return F.array_max(gap)
    if metric == "minkowski":
        return F.pow(array_sum(F.transform(gap, lambda x: F.pow(x, F.lit(p)))), F.lit(1 / p))
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "hamming":
        return array_sum(F.transform(gap, lambda x: F.when(x > 0, 1.0).otherwise(0.0))) / F.size(gap)
    raise ValueError(metric)


def kernel(a: Column, b: Column, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> Column:
    if kind == "linear":
        return dot(a, b)
    if kind == "poly":
        return F.pow(gamma * dot(a, b) + coef0, F.lit(degree))
    if kind == "rbf":
        return F.exp(-gamma * distance(a, b, "sqeuclidean"))
    if kind == "sigmoid":
        return F.tanh(gamma * dot(a, b) + coef0)
    if kind == "laplacian":
        return F.exp(-gamma * distance(a, b, "manhattan"))
    raise ValueError(kind)


def let(value: Column, body) -> Column:
    """Bind a value once, however often a lambda uses it: a lambda would compute it again for each element."""
    return F.transform(F.array(value), body).getItem(0)


def logsumexp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: top + F.ln(array_sum(F.transform(a, lambda x: F.exp(x - top)))))


def softmax(a: Column) -> Column:
    return let(logsumexp(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    spread = lambda mean: F.sqrt(array_sum(F.transform(a, lambda x: (x - mean) * (x - mean))) / F.size(a) + eps)
    return let(array_sum(a) / F.size(a), lambda mean: let(spread(mean), lambda s: F.transform(a, lambda x: (x - mean) / s)))


def rope(a: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotate each even and odd pair by position * base^(-2i/d)."""
    d = F.size(a)

    def turned(x: Column, i: Column) -> Column:
        angle = position * F.pow(F.lit(base), -(i - i % 2).cast("double") / d)
        other = F.get(a, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return F.when(i % 2 == 0, x * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + x * F.cos(angle))

    return F.transform(a, turned)


def positional_encoding(position: Column, d: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(i % 2 == 0, F.sin(position / F.pow(F.lit(10000.0), (i - i % 2).cast("double") / d))).otherwise(F.cos(position / F.pow(F.lit(10000.0), (i - i % 2).cast("double") / d))))


def quantize_block(a: Column, bits: int) -> Column:
    """Symmetric absmax quantise and dequantise, halves to even; an all-zero block stays."""
    top = float((1 << bits - 1) - 1)
    return let(F.array_max(F.transform(a, F.abs)) / top, lambda scale: F.transform(a, lambda x: F.when(scale > 0, F.rint(x / scale) * scale).otherwise(0.0)))


# --- densities and mass functions


def gaussian_logpdf(x: Column, mu: float | Column = 0.0, sigma: float | Column = 1.0) -> Column:
    s = col(sigma)
    return -0.5 * F.pow((x - col(mu)) / s, F.lit(2)) - F.ln(s) - 0.5 * math.log(2 * math.pi)


def laplace_pdf(x: Column, mu: float = 0.0, b: float = 1.0) -> Column:
    return F.exp(-F.abs(x - mu) / b) / (2 * b)


def laplace_cdf(x: Column, mu: float = 0.0, b: float = 1.0) -> Column:
    e = 0.5 * F.exp(-F.abs(x - mu) / b)
    return F.when(x < mu, e).otherwise(1 - e)


def exponential_pdf(x: Column, lam: float = 1.0) -> Column:
    return F.when(x < 0, 0.0).otherwise(lam * F.exp(-lam * x))


def exponential_cdf(x: Column, lam: float = 1.0) -> Column:
    return F.when(x < 0, 0.0).otherwise(1 - F.exp(-lam * x))


def exponential_ppf(q: Column, lam: float = 1.0) -> Column:
    return -F.log1p(-q) / lam


def laplace_ppf(q: Column, mu: float = 0.0, b: float = 1.0) -> Column:
    return mu - b * F.signum(q - 0.5) * F.log1p(-2 * F.abs(q - 0.5))


def uniform_pdf(x: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return F.when((x >= a) & (x <= b), 1 / (b - a)).otherwise(0.0)


def uniform_cdf(x: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return clip((x - a) / (b - a), 0.0, 1.0)


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))


def poisson_pmf(k: Column, lam: float) -> Column:
    return F.exp(k * math.log(lam) - lam - log_factorial(k.cast("int")))


def binomial_pmf(k: Column, n: int, pi: float) -> Column:
    logc = math.lgamma(n + 1) - log_factorial(k.cast("int")) - log_factorial(F.lit(n) - k.cast("int"))
    return F.exp(logc + k * math.log(pi) + (n - k) * math.log1p(-pi))


def geometric_pmf(k: Column, pi: float) -> Column:
    """Trials up to and with the first success."""
    return F.when(k < 1, 0.0).otherwise(F.pow(F.lit(1 - pi), k - 1) * pi)


def bernoulli_pmf(k: Column, pi: float) -> Column:
    return F.when(k == 1, pi).when(k == 0, 1 - pi).otherwise(0.0)
