"""Operator 2: toxicity by cumulative-link ordinal regression over sparse text features.

Severity grades 0..GRADES-1 are ordered: P(grade <= k) = sigmoid(threshold_k - weights . features), with one weight
vector for all thresholds. Features are log(1 + count) of words and of word beginnings (4 to 6 letters).

Training takes at most LABELLED_ROWS labelled documents that docs has, the smallest by hash of their id (a documented bound; the
model, not the corpus, rests on it), in three aggregates that run where the texts are:
which features part toxic from other documents (the FEATURES most telling), the features of the labelled documents, and grades.
Labels say toxic or not, so severity is latent: a toxic document's grade is the third of the toxic documents that it falls in by the score of a
two-class model of the same link, fitted to the other FOLDS - 1 folds and never to the document or its copies. Every document is then scored whole.

Output: the grade probabilities' expected severity, the likeliest grade, and toxic, which holds where P(grade >= 1) >= 0.5.

Defined cases: a null or empty text has no features and gets the thresholds' prior. Labels of ids that repeat count once for each
pair. Without both classes among the labels no document is toxic (severity 0). Texts of any length are scored whole. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, smallest, table

LABELLED_ROWS = 20_000
FEATURES, LEAST_DOCS, LEAST_Z = 6000, 3, 2.3
GRADES, STARTS = 4, (4, 5, 6)
FOLDS, FOLD_ROUNDS, FOLD_RIDGE = 5, 100, 1e-2
KEPT_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")


def counts(text: str) -> Counter:
    """Counts of words, and of word beginnings, which end in an asterisk."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for n in STARTS:
        for w, c in words.items():
            if len(w) > n:
                out[f"{w[:n]}*"] += c
    return out


class OrdinalModel:
    """vocabulary: feature -> place; weights by place; GRADES - 1 rising thresholds."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.places = {f: i for i, f in enumerate(vocabulary)}
        self.weights, self.thresholds = weights, thresholds
        self.kept: dict[str, tuple[int, ...]] = {}
        self.words = {f for f in vocabulary if f[-1] != "*"}
        self.starts = {f[:-1] for f in vocabulary if f[-1] == "*"}

    def places_of(self, word: str) -> tuple[int, ...]:
        """Places of the word and of its beginnings; kept, as texts share most of their words."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        own = [self.places[word]] if word in self.words else []
        own += [self.places[f"{word[:n]}*"] for n in STARTS if len(word) > n and word[:n] in self.starts]
        self.kept[word] = out = tuple(own)
        return out

    def sparse(self, text: str) -> dict[int, float]:
        """Place -> log(1 + count) of the features that the text has."""
        found: dict[int, int] = {}
        get = self.kept.get
        for w, c in Counter(WORD.findall(text.lower())).items():
            own = get(w)
            for f in self.places_of(w) if own is None else own:
                found[f] = found.get(f, 0) + c
        return {f: math.log1p(c) for f, c in found.items()}

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], 1), axis=1)


def fit(at: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, size: int, levels: int = GRADES, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the highest penalised likelihood, by Adam on full passes; entries are (row, feature, value).

    Thresholds are a first value and the logarithms of their gaps, so they always rise.
    """
    n = len(grades)
    share = np.bincount(grades, minlength=levels).cumsum()[:-1] / len(grades)
    cut = np.maximum.accumulate(np.log((share + 1e-3) / (1 - share + 1e-3)))
    v = np.concatenate([np.zeros(size), cut[:1], np.log(np.maximum(np.diff(cut), 0.1))])
    m, s = np.zeros_like(v), np.zeros_like(v)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for t in range(1, rounds + 1):
        gaps = np.exp(v[size + 1 :])
        thresholds = np.concatenate([[-np.inf], v[size] + np.concatenate([[0], gaps.cumsum()]), [np.inf]])
        scores = np.bincount(at, weights=value * v[feature], minlength=n)
        up, low = sigmoid(thresholds[grades + 1] - scores), sigmoid(thresholds[grades] - scores)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        slope = (du - dl) / n
        g = np.zeros_like(v)
        g[:size] = np.bincount(feature, weights=value * slope[at], minlength=size) + ridge * v[:size]
        by = np.zeros(levels + 1)
        np.add.at(by, grades + 1, -du / n)
        np.add.at(by, grades, dl / n)
        inner = by[1:levels]
        g[size] = inner.sum()
        g[size + 1 :] = gaps * inner[::-1].cumsum()[::-1][1:]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return v[:size], v[size] + np.concatenate([[0], np.exp(v[size + 1 :]).cumsum()])


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(id, t, toxic) of the bounded sample, written once."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = smallest(chosen.withColumn("h", F.xxhash64("doc_id")), "h", rows, "doc_id", "toxic").drop("h")
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return materialise(own.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "t", "toxic"), "toxicity-sample")


def telling(sample: DataFrame) -> list[tuple[str, float]]:
    """At most FEATURES features with their z-scores: those that part the classes most clearly."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by: dict[str, list[int]] = {}
            for text, toxic in zip(batch["t"], batch["toxic"], strict=True):
                for f in counts(text):
                    by.setdefault(f, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame({"f": list(by), "n0": [x[0] for x in by.values()], "n1": [x[1] for x in by.values()]})

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return []
    n0, n1 = float(totals[0]), float(totals[1])
    by = sample.select("t", "toxic").mapInPandas(spread, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.ln((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5)) - F.ln((F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5))
    spread_ = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (n1 - F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5) + 1 / (n0 - F.col("n0") + 0.5))
    by = by.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumn("z", odds / spread_).where(F.abs("z") >= LEAST_Z)
    return [(r["f"], r["z"]) for r in by.orderBy(F.desc(F.abs("z")), "f").limit(FEATURES).collect()]


def severities(at: np.ndarray, feature: np.ndarray, value: np.ndarray, toxic: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Grade of each labelled row: 0 for what is not toxic; a toxic row's third among the toxic rows by the score of a model that has not seen the row.

    Rows with equal keys share a fold, so copies do not vouch for each other.
    """
    fold, score = keys % FOLDS, np.zeros(len(toxic))
    for k in range(FOLDS):
        own = fold == k
        rest = np.flatnonzero(~own)
        if not own.any() or len(np.unique(toxic[rest])) < 2:
            continue
        place = np.full(len(toxic), -1)
        place[rest] = np.arange(len(rest))
        seen = ~own[at]
        weights, _ = fit(place[at[seen]], feature[seen], value[seen], toxic[rest], size, levels=2, rounds=FOLD_ROUNDS, ridge=FOLD_RIDGE)
        score += own * np.bincount(at, weights=value * weights[feature], minlength=len(toxic))
    cuts = np.quantile(score[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, score, side="right"), 0)


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> OrdinalModel | None:
    """None where the labels lack a class or no feature parts them."""
    sample = labelled(docs, labels, rows)
    found = telling(sample)
    if not found:
        return None
    vocabulary = [f for f, _ in found]
    empty = OrdinalModel(vocabulary, np.zeros(len(vocabulary)), np.zeros(GRADES - 1))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [empty.sparse(t) for t in batch["t"]]
            yield pd.DataFrame({"id": batch["id"].astype(str), "h": batch["h"], "toxic": batch["toxic"], "places": [list(x) for x in own], "values": [list(x.values()) for x in own]})

    got = sample.withColumn("h", F.xxhash64("id", "t")).mapInPandas(features, "id string, h long, toxic int, places array<int>, values array<double>").toPandas().sort_values(["h", "id", "toxic"], kind="stable")
    at = np.repeat(np.arange(len(got)), got["places"].map(len))
    feature, value = (np.concatenate([np.empty(0, kind), *got[c]]).astype(kind) for c, kind in (("places", np.int32), ("values", np.float64)))
    toxic = got["toxic"].to_numpy()
    grades = severities(at, feature, value, toxic, got["h"].to_numpy(), len(vocabulary))
    return OrdinalModel(vocabulary, *fit(at, feature, value, grades, len(vocabulary)))


def score(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic and toxic, a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            if model is None:
                p = np.tile([1.0, *[0.0] * (GRADES - 1)], (len(batch), 1))
            else:
                p = model.probabilities(np.array([sum(model.weights[f] * v for f, v in model.sparse(t if isinstance(t, str) else "").items()) for t in batch["t"]], float).reshape(-1))
            toxic = p[:, 1:].sum(1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "expected_severity": (p @ np.arange(GRADES)).round(9), "grade": p.argmax(1), "p_toxic": toxic.round(9), "toxic": toxic >= 0.5})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("t"))
    return rows.mapInPandas(judge, f"doc_id {kind}, expected_severity double, grade long, p_toxic double, toxic boolean")


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
