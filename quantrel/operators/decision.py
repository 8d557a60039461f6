"""Decision processes, decoding of distributions, beam search, preferences and scaling laws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantrel import functions as fn

from .storage import cut


def action_values(transitions: DataFrame, values: DataFrame, gamma: float) -> DataFrame:
    """(s, a, q) from transitions (s, a, s2, p, r) and values (s, v)."""
    v = values.select(F.col("s").alias("s2"), "v")
    return transitions.join(v, "s2", "left").groupBy("s", "a").agg(F.sum(F.col("p") * (F.col("r") + gamma * F.coalesce("v", F.lit(0.0)))).alias("q"))


def greedy(q: DataFrame) -> DataFrame:
    """(s, a, v): the best action, the lowest on ties."""
    return q.groupBy("s").agg(F.max(F.struct("q", (-F.col("a")).alias("a"))).alias("b")).select("s", (-F.col("b.a")).alias("a"), F.col("b.q").alias("v"))


def value_sweeps(transitions: DataFrame, gamma: float, sweeps: int) -> DataFrame:
    """(s, v) after a fixed number of sweeps from zero."""
    values = transitions.select("s").distinct().withColumn("v", F.lit(0.0))
    for i in range(sweeps):
        values = greedy(action_values(transitions, values, gamma)).select("s", "v")
        if i % 5 == 4:
            values = cut(values)
    return values


def value_iteration(transitions: DataFrame, gamma: float, tol: float = 1e-10, most: int = 1000) -> DataFrame:
    values = cut(transitions.select("s").distinct().withColumn("v", F.lit(0.0)))
    for _ in range(most):
        new = cut(greedy(action_values(transitions, values, gamma)))
        gap = new.select("s", F.col("v").alias("n")).join(values, "s").agg(F.max(F.abs(F.col("n") - F.col("v")))).first()[0]
        values = new.select("s", "v")
        if gap < tol:
            return new
    return new


def policy_evaluation(transitions: DataFrame, policy: DataFrame, gamma: float, sweeps: int) -> DataFrame:
    """(s, v) of a policy (s, a, pi) after a fixed number of sweeps."""
    values = transitions.select("s").distinct().withColumn("v", F.lit(0.0))
    for i in range(sweeps):
        values = action_values(transitions, values, gamma).join(policy, ["s", "a"]).groupBy("s").agg(F.sum(F.col("pi") * F.col("q")).alias("v"))
        if i % 5 == 4:
            values = cut(values)
    return values


def exact_values(transitions: DataFrame, policy: DataFrame, gamma: float, most: int = 5000) -> DataFrame:
    """(s, v) of a policy by one linear solve; state spaces of more than `most` are refused."""
    rows = transitions.join(policy, ["s", "a"]).groupBy("s", "s2").agg(F.sum(F.col("p") * F.col("pi")).alias("p"), F.sum(F.col("p") * F.col("pi") * F.col("r")).alias("r"))
    states = [r[0] for r in transitions.select("s").distinct().orderBy("s").limit(most + 1).collect()]
    if len(states) > most:
        raise ValueError(f"an exact solve takes at most {most} states")
    at = {s: i for i, s in enumerate(states)}
    m, b = np.eye(len(states)), np.zeros(len(states))
    for r in rows.collect():
        m[at[r["s"]], at[r["s2"]]] -= gamma * r["p"]
        b[at[r["s"]]] += r["r"]
    v = np.linalg.solve(m, b)
    return transitions.sparkSession.createDataFrame([(s, float(v[i])) for s, i in at.items()], "s long, v double")


def policy_iteration(transitions: DataFrame, gamma: float) -> tuple[DataFrame, int]:
    """(s, a, v) and the number of improvement steps."""
    policy = transitions.groupBy("s").agg(F.min("a").alias("a"))
    for step in range(1, 100):
        values = exact_values(transitions, policy.select("s", "a").withColumn("pi", F.lit(1.0)), gamma)
        q = action_values(transitions, values, gamma).withColumn("q", F.round("q", 9))
        new = cut(greedy(q))
        if not new.select("s", F.col("a").alias("b")).join(policy, "s").where("a <> b").limit(1).count():
            return new, step
        policy = new
    return new, step


def transition_matrix(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(state, next, n, p) of successive states."""
    w = Window.partitionBy(key).orderBy(*order)
    n = df.withColumn("next", F.lead(state).over(w)).where("next is not null").groupBy(state, "next").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(state)))


def token_shares(df: DataFrame, group: str, logit: Column, temperature: float = 1.0) -> DataFrame:
    """Adds share: softmax of logit / temperature within the group."""
    w = Window.partitionBy(group)
    z = df.withColumn("__z", logit / temperature).withColumn("__e", F.exp(F.col("__z") - F.max("__z").over(w)))
    return z.withColumn("share", F.col("__e") / F.sum("__e").over(w)).drop("__z", "__e")


def top_k_shares(shares: DataFrame, group: str, token: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("share"), token)
    kept = shares.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return kept.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(group)))


def top_p_shares(shares: DataFrame, group: str, token: str, mass: float) -> DataFrame:
    """The fewest likeliest tokens whose mass reaches the bound, renormalised."""
    w = Window.partitionBy(group).orderBy(F.desc("share"), token).rowsBetween(Window.unboundedPreceding, -1)
    kept = shares.withColumn("before", F.coalesce(F.sum("share").over(w), F.lit(0.0))).where(F.col("before") < mass)
    return kept.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(group))).drop("before")


def beam_search(steps: DataFrame, width: int, length: int) -> DataFrame:
    """(text, score) of the best sequences of `length` tokens from a table (prev, tok, lp); prev is '' at the start. Width 1 is greedy."""
    beams = steps.where("prev = ''").select(F.col("tok").alias("text"), F.col("tok").alias("last"), F.col("lp").alias("score"))
    best = lambda d: d.orderBy(F.desc("score"), "text").limit(width)
    beams = best(beams)
    for _ in range(length - 1):
        beams = best(beams.join(steps, F.col("last") == F.col("prev")).select(F.concat("text", "tok").alias("text"), F.col("tok").alias("last"), (F.col("score") + F.col("lp")).alias("score")))
    return beams.select("text", "score")


def route_top(gates: DataFrame, token: str, expert: str, logit: Column, k: int = 2) -> DataFrame:
    """(token, expert, weight): softmax over the k largest gates of each token."""
    w = Window.partitionBy(token).orderBy(logit.desc(), expert)
    kept = gates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return token_shares(kept, token, logit).select(token, expert, F.col("share").alias("weight"))


def bradley_terry(pairs: DataFrame, winner: str, loser: str, rounds: int = 100) -> DataFrame:
    """(item, strength), mean 0 in logs, by the minorise-maximise steps; pairs are first counted."""
    n = cut(pairs.groupBy(F.col(winner).alias("w"), F.col(loser).alias("l")).agg(F.count(F.lit(1)).alias("n")))
    wins = n.groupBy(F.col("w").alias("item")).agg(F.sum("n").alias("wins"))
    met = cut(n.select("w", "l", "n").union(n.select("l", "w", "n")).groupBy(F.col("w").alias("a"), F.col("l").alias("b")).agg(F.sum("n").alias("n")))
    s = cut(met.select(F.col("a").alias("item")).distinct().withColumn("strength", F.lit(1.0)))
    for i in range(rounds):
        d = met.join(s.select(F.col("item").alias("a"), F.col("strength").alias("sa")), "a").join(s.select(F.col("item").alias("b"), F.col("strength").alias("sb")), "b")
        d = d.groupBy(F.col("a").alias("item")).agg(F.sum(F.col("n") / (F.col("sa") + F.col("sb"))).alias("d"))
        s = d.join(wins, "item", "left").select("item", ((F.coalesce("wins", F.lit(0)) + 0.1) / F.col("d")).alias("strength"))
        s = s.withColumn("strength", F.col("strength") / F.exp(F.avg(F.ln("strength")).over(Window.partitionBy())))
        if i % 5 == 4:
            s = cut(s)
    return s


def preference_loss(pairs: DataFrame, margin: Column, beta: float) -> DataFrame:
    """Mean -ln sigmoid(beta * margin): the direct preference objective."""
    return pairs.agg(F.avg(fn.softplus(-beta * margin)).alias("loss"), F.avg((margin > 0).cast("double")).alias("accuracy"))


def tilted_policy(df: DataFrame, group: str, reference: Column, reward: Column, beta: float) -> DataFrame:
    """Adds share: the policy of greatest reward less beta * KL to the reference, reference * exp(reward / beta) normalised."""
    return token_shares(df, group, F.ln(reference) + reward / beta)


#: Fixed values of the loss law: floor, and scale and exponent of parameters and of tokens.
LOSS_LAW = (1.69, 406.4, 0.34, 410.7, 0.28)


def scaling_loss(n: Column, d: Column) -> Column:
    e, a, alpha, b, beta = LOSS_LAW
    return e + a / F.pow(n, F.lit(alpha)) + b / F.pow(d, F.lit(beta))


def compute_optimal(spark, budget: float, low: float = 1e6, high: float = 1e13, grid: int = 6000) -> DataFrame:
    """Parameters, tokens (budget / 6n) and loss at the best point of a log grid."""
    step = (math.log10(high) - math.log10(low)) / (grid - 1)
    rows = spark.range(grid).select(F.pow(F.lit(10.0), F.lit(math.log10(low)) + F.col("id") * step).alias("n"))
    rows = rows.withColumn("d", budget / 6 / F.col("n")).withColumn("loss", scaling_loss(F.col("n"), F.col("d")))
    return rows.agg(F.min(F.struct("loss", "n", "d")).alias("b")).select("b.n", "b.d", "b.loss")


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and R2 of ln y on ln x."""
    return df.agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.regr_intercept(F.ln(y), F.ln(x)).alias("intercept"), F.regr_r2(F.ln(y), F.ln(x)).alias("r2"))


def diffusion_schedule(spark, steps: int = 40, low: float = 1e-4, high: float = 0.15) -> DataFrame:
    """t, beta, alpha_bar and signal-to-noise ratio of a linear schedule."""
    rows = spark.range(steps).select(F.col("id").alias("t"), (low + F.col("id") * ((high - low) / (steps - 1))).alias("beta"))
    bar = F.exp(F.sum(F.ln(1 - F.col("beta"))).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("alpha_bar", bar).withColumn("snr", F.col("alpha_bar") / (1 - F.col("alpha_bar")))


def cache_bytes(layers: int, kv_heads: int, head: int, tokens: int, bytes_each: int = 2) -> int:
    """Size of a key-value cache."""
    return 2 * layers * kv_heads * head * tokens * bytes_each
