"""Estimators, intervals, tests and corrections. Sufficient statistics are aggregates; quantiles and tails are scalar functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantrel import functions as fn

from .storage import cut

#: Standard deviations around a permutation's expected cut within which rows are ranked; beyond, they are only counted.
DEVIATIONS = 6


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the continued fraction of Lentz."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    p = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return p if t >= 0 else 1 - p


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(q: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) < q else (low, mid)
    return (low + high) / 2


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def moments(df: DataFrame, x: str, *by: str) -> DataFrame:
    v = F.col(x).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_mle"), F.var_samp(v).alias("var_unbiased"))


def z_interval(df: DataFrame, x: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """low, high: mean -+ z * s / sqrt(n)."""
    half = F.lit(normal_quantile(1 - alpha / 2)) * F.sqrt(F.col("var_unbiased") / F.col("n"))
    return moments(df, x, *by).select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def t_interval(df: DataFrame, x: str, alpha: float = 0.05) -> dict[str, float]:
    r = moments(df, x).first()
    half = t_quantile(1 - alpha / 2, r["n"] - 1) * math.sqrt(r["var_unbiased"] / r["n"])
    return {"mean": r["mean"], "low": r["mean"] - half, "high": r["mean"] + half}


def proportion_intervals(df: DataFrame, success: Column, *by: str, alpha: float = 0.05) -> DataFrame:
    """Wilson (within [0, 1]) and naive intervals of the share of rows where `success` holds."""
    z = normal_quantile(1 - alpha / 2)
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("k")).withColumn("p", F.col("k") / F.col("n"))
    p, n, z2 = F.col("p"), F.col("n"), z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    wald = z * F.sqrt(p * (1 - p) / n)
    return rows.select(*by, "n", "k", "p", F.greatest(mid - half, F.lit(0.0)).alias("wilson_low"), F.least(mid + half, F.lit(1.0)).alias("wilson_high"), (p - wald).alias("wald_low"), (p + wald).alias("wald_high"))


def t_tests(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """Pooled and Welch statistics with degrees of freedom for groups a and b, from one aggregate."""
    v = F.col(x).cast("double")
    parts = []
    for name, g in (("a", a), ("b", b)):
        own = F.when(F.col(group) == g, v)
        parts += [F.count(own).alias(f"n_{name}"), F.avg(own).alias(f"mean_{name}"), F.var_samp(own).alias(f"var_{name}")]
    r = df.agg(*parts)
    na, nb, va, vb = (F.col(c).cast("double") for c in ("n_a", "n_b", "var_a", "var_b"))
    gap = F.col("mean_a") - F.col("mean_b")
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    ea, eb = va / na, vb / nb
    return r.select("*", (gap / F.sqrt(pooled * (1 / na + 1 / nb))).alias("student_t"), (na + nb - 2).alias("student_df"), (gap / F.sqrt(ea + eb)).alias("welch_t"), ((ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1))).alias("welch_df"))


def two_sided(t: float, df: float) -> float:
    return 2 * t_tail(abs(t), df)


def permutation_test(df: DataFrame, x: str, in_a: Column, key: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """p of |mean_a - mean_b| over `rounds` relabellings that keep the groups' sizes: in each round the rows of the smallest hashes of (round, key) are group a.

    Hashes are uniform, so the n_a-th smallest lies within some deviations of n_a / n: rows beyond are only counted and summed by round, rows
    within are ranked by (hash, key, value). If the cut of any round should lie outside, all rows are ranked.
    """
    rows = df.select(F.col(x).cast("double").alias("v"), in_a.cast("int").alias("a"), F.col(key).alias("k")).where("a is not null")
    seen = rows.agg(F.avg(F.when(F.col("a") == 1, F.col("v"))).alias("ma"), F.avg(F.when(F.col("a") == 0, F.col("v"))).alias("mb"), F.sum("a").alias("na"), F.count("a").alias("n")).first()
    if not seen["na"] or seen["na"] == seen["n"]:
        return df.sparkSession.createDataFrame([(None, None)], "p double, observed double")
    share, n = seen["na"] / seen["n"], seen["n"]
    spread = rows.select("v", "k").repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "k")  # a row is `rounds` hashes of work
    dealt = spread.select("v", "k", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("u", fn.hashed_uniform(F.lit(seed), F.col("round"), F.col("k")))
    for width in (DEVIATIONS * math.sqrt(share * (1 - share) / n) + 1 / n, 1.0):
        near = F.col("u").between(share - width, share + width)
        place = F.when(near, F.col("u")).when(F.col("u") < share, F.lit(-1.0)).otherwise(F.lit(2.0))
        sums = cut(dealt.groupBy("round", place.alias("u"), F.when(near, F.col("k")).alias("k"), F.when(near, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count(dealt["v"]).alias("c"), F.sum(dealt["v"]).alias("s")))
        sides = sums.groupBy("round").agg(F.sum(F.when(F.col("u") < 0, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("u") > 1, F.col("n")).otherwise(0)).alias("high"))
        if sides.where((F.col("low") > seen["na"]) | (F.col("high") > n - seen["na"])).isEmpty():
            break
    before = F.sum("n").over(Window.partitionBy("round").orderBy("u", "k", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sums.withColumn("inside", F.greatest(F.least(F.lit(seen["na"]) - (before - F.col("n")), F.col("n")), F.lit(0)) / F.col("n"))  # a part of a row that occurs often
    mean = lambda part: fn.ratio(F.sum(F.col("s") * part), F.sum(F.col("c") * part))
    gaps = ranked.groupBy("round").agg((mean(F.col("inside")) - mean(1 - F.col("inside"))).alias("gap"))
    observed = seen["ma"] - seen["mb"]
    return gaps.agg(((F.count_if(F.abs("gap") >= F.lit(abs(observed))) + 1) / (F.count("gap") + 1)).alias("p"), F.lit(observed).alias("observed"))


def bootstrap(df: DataFrame, statistic: Column, key: str, rounds: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """estimate, se, low, high of any aggregate `statistic` that weighs rows by their column w (copies in a replicate, Poisson(1) by hash of round and key):
    percentile interval over `rounds` replicates; what leaves a task is each replicate's partial sums."""
    weight = F.lit(0)
    for k in range(8):
        weight = weight + (F.col("u") >= F.lit(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))).cast("int")
    dealt = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", fn.hashed_uniform(F.lit(seed), F.col("round"), F.col(key))).withColumn("w", weight)
    each = dealt.groupBy("round").agg(statistic.alias("s"))
    return each.agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("se"), F.percentile("s", F.lit(alpha / 2)).alias("low"), F.percentile("s", F.lit(1 - alpha / 2)).alias("high"))


def bootstrap_mean(df: DataFrame, x: str, key: str, rounds: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    v = F.col(x).cast("double")
    return bootstrap(df, F.sum(F.col("w") * v) / F.sum("w"), key, rounds, alpha, seed)


def mcnemar(df: DataFrame, right_a: Column, right_b: Column) -> DataFrame:
    """Discordant counts, the corrected chi-square and the exact two-sided binomial p (1 where nothing is discordant)."""
    r = df.agg(F.count_if(~right_a & right_b).alias("n01"), F.count_if(right_a & ~right_b).alias("n10"))
    n = F.col("n01") + F.col("n10")
    gap = F.greatest(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(0))
    return r.withColumn("chi2", F.coalesce(fn.ratio(gap * gap, n), F.lit(0.0)))


def mcnemar_exact(n01: int, n10: int) -> float:
    n, k = n01 + n10, min(n01, n10)
    if not n:
        return 1.0
    return min(1.0, 2 * math.exp(max(logs := [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)])) * sum(math.exp(x - max(logs)) for x in logs))


def corrections(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Bonferroni, Holm (stops at its first failure) and Benjamini-Hochberg (up to its last success) rejections. One row is one hypothesis."""
    order = Window.orderBy(F.col(p), F.col(key))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = df.withColumn("m", m).withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("holm_ok", F.col(p) <= F.lit(alpha) / (F.col("m") - F.col("rank") + 1)).withColumn("bh_ok", F.col(p) <= F.lit(alpha) * F.col("rank") / F.col("m"))
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select(key, p, (F.col(p) <= F.lit(alpha) / F.col("m")).alias("bonferroni"), F.min("holm_ok").over(before).alias("holm"), F.max("bh_ok").over(rest).alias("benjamini_hochberg"))


def quantile_edges(df: DataFrame, x: str, bins: int, *by: str) -> DataFrame:
    """by, edges: the exact inner quantiles (linear between order statistics)."""
    return df.groupBy(*by).agg(F.percentile(x, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges"))


def quantile_bins(df: DataFrame, x: str, bins: int, *by: str, out: str = "bin") -> DataFrame:
    """Adds the number of edges at or below x, from 0: edges are one row a group and joined back."""
    edges = quantile_edges(df, x, bins, *by)
    joined = df.join(F.broadcast(edges), list(by)) if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn(out, F.size(F.filter("edges", lambda e: e <= F.col(x)))).drop("edges")


def histogram_2d(df: DataFrame, x: str, y: str, x_bins: tuple[float, float, int], y_bins: tuple[float, float, int]) -> DataFrame:
    """bx, by, n for equal-width bins (low, high, bins); the last bin holds its upper edge, values outside are left out."""
    place = lambda c, b: F.least(F.floor((F.col(c) - b[0]) / ((b[1] - b[0]) / b[2])), F.lit(b[2] - 1)).cast("long")
    rows = df.where(F.col(x).between(*x_bins[:2]) & F.col(y).between(*y_bins[:2]))
    return rows.groupBy(place(x, x_bins).alias("bx"), place(y, y_bins).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def posterior_of_test(prevalence: Column, sensitivity: Column, specificity: Column) -> list[Column]:
    """Posterior of a positive test, with what explains it."""
    tp, fp = sensitivity * prevalence, (1 - specificity) * (1 - prevalence)
    named = {"posterior": tp / (tp + fp), "p_positive": tp + fp, "false_to_true_ratio": fp / tp, "likelihood_ratio": sensitivity / (1 - specificity), "prior_odds": prevalence / (1 - prevalence)}
    return [v.alias(k) for k, v in named.items()]


def fisher_information(df: DataFrame, success: Column, x: str, *by: str) -> DataFrame:
    """by, bernoulli (1 / (p (1 - p))) and gaussian_mean (1 / variance), each for one row, and n."""
    p, v = F.avg(success.cast("double")), F.var_pop(x)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), fn.ratio(F.lit(1.0), p * (1 - p)).alias("bernoulli"), fn.ratio(F.lit(1.0), v).alias("gaussian_mean"))


def measure_estimators(samples: DataFrame, trial: str, estimators: dict[str, Column], truth: float) -> DataFrame:
    """estimator, bias, variance (over trials, ddof 0) and mse of aggregates that are evaluated once for each trial's rows."""
    each = samples.groupBy(trial).agg(*(e.cast("double").alias(k) for k, e in estimators.items()))
    long = each.select(F.explode(F.array(*(F.struct(F.lit(k).alias("estimator"), F.col(k).alias("v")) for k in estimators))).alias("x")).select("x.*")
    return long.groupBy("estimator").agg((F.avg("v") - truth).alias("bias"), F.var_pop("v").alias("variance"), F.avg(F.pow(F.col("v") - truth, F.lit(2))).alias("mse"))


def welch_by_group(df: DataFrame, x: str, in_a: Column, in_b: Column, *by: str) -> DataFrame:
    """by, t, df: Welch's test of every group in one aggregate."""
    part = lambda c: (F.count_if(c), F.avg(F.when(c, F.col(x))), F.var_samp(F.when(c, F.col(x))))
    (na, ma, va), (nb, mb, vb) = part(in_a), part(in_b)
    r = df.groupBy(*by).agg(na.alias("na"), ma.alias("ma"), (va / na).alias("ea"), nb.alias("nb"), mb.alias("mb"), (vb / nb).alias("eb"))
    e = F.col("ea") + F.col("eb")
    return r.select(*by, ((F.col("ma") - F.col("mb")) / F.sqrt(e)).alias("t"), (e * e / (F.col("ea") * F.col("ea") / (F.col("na") - 1) + F.col("eb") * F.col("eb") / (F.col("nb") - 1))).alias("df"))


def bias_variance(samples: DataFrame, dataset: str, x: str, y: str, grid: DataFrame, truth: Column, noise: float) -> DataFrame:
    """x, bias2, variance, total: a straight line fitted to each dataset in one aggregate, judged on grid (x) against truth(x)."""
    fits = samples.groupBy(dataset).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    at = fits.join(F.broadcast(grid)).withColumn("p", F.col("a") + F.col("b") * F.col(x)).withColumn("f", truth)
    r = at.groupBy(x).agg(F.pow(F.avg("p") - F.max("f"), F.lit(2)).alias("bias2"), F.var_pop("p").alias("variance"))
    return r.select(x, "bias2", "variance", (F.col("bias2") + F.col("variance") + noise * noise).alias("total"))


def gaussian_conditional(df: DataFrame, x: str, y: str, at: list[float]) -> DataFrame:
    """x, mean, variance of y given x under the joint normal of both, and y's marginal mean and variance."""
    row = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    given = row.select("*", F.explode(F.array(*map(F.lit, at))).alias("x"))
    slope = fn.ratio(F.col("c"), F.col("vx"))
    return given.select("x", (F.col("my") + slope * (F.col("x") - F.col("mx"))).alias("mean"), (F.col("vy") - slope * F.col("c")).alias("variance"), F.col("my").alias("marginal_mean"), F.col("vy").alias("marginal_variance"))
