"""Operator 3: URL filters by a character language-model ratio, after rules on host and path.

Rules decide first; the longest that fits wins. URLs without a rule go to two variable-order Markov
models over UTF-8 bytes, one of accepted and one of rejected URLs, smoothed by interpolating every order with the next
lower one (Witten-Bell). The score is the difference of log-likelihoods by byte. A logistic curve fitted on held-out URLs
calibrates it, and a URL is blocked where its probability of acceptance is under one half.

Both models are trained on URLs that rules decided: at most SAMPLE of each verdict, the smallest by hash of id and url
(a documented bound; scores and counts cover every page).

Defined cases: a null url, or one without `://`, has empty host and path and fits no rule; null and empty urls score 0. URLs of any length are
scored whole, with scheme, query and fragment. Repeated rows are judged alike. Where either class has no examples, the method allows every URL. Extra columns are kept
by with_verdict().
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, reserve, smallest, table

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SAMPLE, ORDER, HELD_OUT = 5000, 5, 5
CACHE = 200_000


class MarkovModel:
    """Interpolated variable-order model over bytes, 256 standing for the end."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, [defaultdict(dict) for _ in range(order + 1)]

    def add(self, text: str) -> None:
        data = text.encode()
        for i in range(len(data) + 1):
            c = data[i] if i < len(data) else 256
            for k in range(min(i, self.order) + 1):
                seen = self.counts[k][data[i - k : i]]
                seen[c] = seen.get(c, 0) + 1

    def log_prob(self, context: bytes, c: int) -> float:
        p = 1 / 257
        for k in range(len(context) + 1):
            seen = self.counts[k].get(context[len(context) - k :])
            if not seen:
                break
            n, kinds = sum(seen.values()), len(seen)
            p = (seen.get(c, 0) + kinds * p) / (n + kinds)
        return math.log(p)


class Ratio:
    """Length-normalised log-likelihood difference with its calibration."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        self.order, self.cache = order, {}
        self.models = (MarkovModel(order), MarkovModel(order))
        self.a, self.b, self.trained = 1.0, 0.0, bool(accepted and rejected)
        if not self.trained:
            return
        held: list[tuple[str, int]] = []
        for model, texts, y in ((self.models[0], accepted, 1), (self.models[1], rejected, 0)):
            for i, text in enumerate(texts):
                if i % HELD_OUT == HELD_OUT - 1:
                    held.append((text, y))
                else:
                    model.add(text)
        if len({y for _, y in held}) == 2:
            self.a, self.b = self.calibrate(np.array([self.score(t) for t, _ in held]), np.array([y for _, y in held], float))

    @staticmethod
    def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Platt scaling with a small ridge, by Newton steps; classes weigh the same."""
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        v, m = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(m @ v, -30, 30)))
            g = m.T @ (weight * (p - y)) + 1e-3 * v
            h = (m * (weight * p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
            v = v - np.linalg.solve(h, g)
        return float(v[0]), float(v[1])

    def score(self, text: str) -> float:
        data, total, cache, k = text.encode(), 0.0, self.cache, self.order
        if not data:
            return 0.0
        for i in range(len(data) + 1):
            key = (data[max(0, i - k) : i], data[i] if i < len(data) else 256)
            found = cache.get(key)
            if found is None:
                if len(cache) > CACHE:
                    cache.clear()
                found = cache[key] = self.models[0].log_prob(*key) - self.models[1].log_prob(*key)
            total += found
        return total / (len(data) + 1)

    def accepts(self, score: float) -> bool:
        return not self.trained or self.a * score + self.b >= 0


def host_and_path(url: Column) -> tuple[Column, Column]:
    shape, own = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(own, shape, 1)), F.regexp_extract(own, shape, 2)


def best_rule(host: Column, path: Column) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null where none does."""
    found = F
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = found.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def with_verdict(df: DataFrame, id_column: str = "page_id", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Adds host, path, rule, verdict and score (of URLs without a rule); columns of df that clash are replaced."""
    n = reserve(df, "host", "path", "rule", "score")
    host, path = host_and_path(F.col(f"`{url}`"))
    judged = df.withColumn(n["host"], host).withColumn(n["path"], path)
    judged = judged.withColumn(n["rule"], best_rule(F.col(n["host"]), F.col(n["path"])))
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))

    def examples(verdict: str) -> list[str]:
        own = judged.where(F.col(n["rule"])["verdict"] == verdict).select(text.alias("t"), F.xxhash64(f"`{id_column}`", f"`{url}`").alias("h"))
        return [r["t"] for r in smallest(own, "h", sample, "t").collect()]

    shared = df.sparkSession.sparkContext.broadcast(Ratio(examples("allow"), examples("block")))

    @F.pandas_udf("struct<score: double, accepted: boolean>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ratio = shared.value
        for batch in texts:
            scores = [None if t is None else ratio.score(t) for t in batch]
            yield pd.DataFrame({"score": [None if s is None else round(s, 9) for s in scores], "accepted": [None if s is None else ratio.accepts(s) for s in scores]})

    judged = judged.withColumn(n["score"], score(F.when(F.col(n["rule"]).isNull(), text)))
    method = F.when(F.col(n["score"])["accepted"], "allow").otherwise("block")
    added = {"host": F.col(n["host"]), "path": F.col(n["path"]), "rule": F.col(n["rule"])["rule"], "verdict": F.coalesce(F.col(n["rule"])["verdict"], method), "score": F.col(n["score"])["score"]}
    return judged.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in added), *(v.alias(k) for k, v in added.items()))


def op3_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
