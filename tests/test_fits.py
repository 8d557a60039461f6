"""Registered fits that SQL does not express, against plain numpy over the same tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quantrel.operators import clustering as cl
from quantrel.operators import metrics, ordered

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def four():
    rows = duckdb.sql(f"SELECT vec_id, label, embedding[1:4] FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)


def by_id(spark, name):
    return {r["vec_id"]: r for r in entry.queries()[name](spark, DATA).collect()}


def normal(x, mean, cov):
    z = x - mean
    return -0.5 * (np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1] + x.shape[1] * math.log(2 * math.pi))


def test_discriminants(spark, four):
    ids, label, x = four
    classes = sorted(set(label))
    scatter = {c: (x[label == c] - x[label == c].mean(0)).T @ (x[label == c] - x[label == c].mean(0)) for c in classes}
    pooled = sum(scatter.values()) / (len(x) - len(classes))
    got = by_id(spark, "discriminant_analysis")
    for name, gamma in (("lda", 0.0), ("rda", 0.5), ("qda", 1.0)):
        logs = np.stack([math.log((label == c).mean()) + normal(x, x[label == c].mean(0), gamma * scatter[c] / max((label == c).sum() - 1, 1) + (1 - gamma) * pooled + 1e-6 * np.eye(4)) for c in classes], 1)
        order = np.sort(logs, 1)
        clear = order[:, -1] - order[:, -2] > 1e-6
        assert clear.mean() > 0.9
        assert all(got[i][name] == classes[k] for i, k, ok in zip(ids, logs.argmax(1), clear, strict=True) if ok)


def test_principal_components(spark, four):
    ids, _, x = four
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = by_id(spark, "pca_projection")
    z = np.array([[got[i]["z0"], got[i]["z1"]] for i in ids])
    assert np.abs(z) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-5)
    assert [got[i]["residual"] for i in ids] == pytest.approx(((u[:, 2:] * s[2:]) ** 2).sum(1), abs=1e-5)


def test_mixture(spark, four):
    _, _, x = four
    x = x[:, :2]
    n, means, weights = len(x), [np.array(m) for m in ([-0.1, 0.0], [0.1, 0.0], [0.0, 0.1])], [1 / 3] * 3
    covs, last = [np.cov(x.T, bias=True) + 1e-6 * np.eye(2)] * 3, -math.inf
    for _ in range(10):
        logs = np.stack([math.log(w) + normal(x, m, c) for w, m, c in zip(weights, means, covs, strict=True)], 1)
        top = logs.max(1, keepdims=True)
        z = (top + np.log(np.exp(logs - top).sum(1, keepdims=True)))[:, 0]
        r = np.exp(logs - z[:, None])
        weights = list(r.mean(0))
        means = [r[:, k] @ x / r[:, k].sum() for k in range(3)]
        covs = [((x - means[k]).T * r[:, k]) @ (x - means[k]) / r[:, k].sum() + 1e-6 * np.eye(2) for k in range(3)]
        if abs(z.sum() - last) < 1e-6 * n:
            break
        last = z.sum()
    got = sorted(entry.queries()["gaussian_mixture"](spark, DATA).collect())
    assert [r["weight"] for r in got] == pytest.approx(weights, abs=1e-6)
    assert [(r["x0"], r["x1"]) for r in got] == [pytest.approx(tuple(m), abs=1e-6) for m in means]
    assert got[0]["bic"] == pytest.approx(-2 * z.sum() + 17 * math.log(n), abs=1e-4)


def test_tied_mixture(spark):
    """Two clouds of one shape: the tied covariance is theirs, and its parameters are counted once."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, [0.5, 1.0], (400, 2)) for c in (-4, 4)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    r = cl.mixture(df, ["a", "b"], [[-3.0, -3.0], [3.0, 3.0]], rounds=20, kind="tied")
    (_, m, c), (_, _, c2) = r["model"]
    own = sum(np.cov(p.T, bias=True) for p in (x[:400], x[400:])) / 2
    assert (c == c2).all() and c == pytest.approx(own, abs=1e-3) and m == pytest.approx(x[:400].mean(0), abs=1e-3)
    assert r["bic"] == pytest.approx(-2 * r["log_likelihood"] + (1 + 4 + 3) * math.log(800))


def test_one_score_of_most_rows(spark):
    """A score that holds most rows is cut by the tie order; totals and average precision stay those of one sorted list."""
    rng = np.random.default_rng(5)
    rows = [(i, 0.5 if i % 10 else float(rng.integers(0, 4)) / 3, int(rng.random() < 0.4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    assert ordered.dealt(df, "score", ("id",)).where("score = 0.5").select("__bucket", "__sub").distinct().count() > 1
    listed = sorted(rows, key=lambda r: (-r[1], r[0]))
    hits = np.cumsum([r[2] for r in listed])
    want = np.mean([hits[i] / (i + 1) for i, r in enumerate(listed) if r[2]])
    assert metrics.average_precision(df, "y", "score", ("id",)).first()[0] == pytest.approx(want, abs=1e-9)
    places = {r["id"]: r["rn"] for r in ordered.numbered(df, "score", ties=("id",)).collect()}
    assert places == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_policy_iteration(spark):
    """On the 4 x 4 grid the best value is the discounted way to the goal, and each action leads one step nearer."""
    far = lambda s: (3 - s // 4) + (3 - s % 4)
    got = {r["s"]: r for r in entry.queries()["policy_iteration"](spark, DATA).collect()}
    assert sorted(got) == list(range(16))
    for s, r in got.items():
        assert r["v"] == pytest.approx(-(1 - 0.9 ** far(s)) / (1 - 0.9), abs=1e-6)
        moved = {0: s - 4, 1: s + 4, 2: s - 1, 3: s + 1}[r["a"]]
        assert s == 15 or far(moved) == far(s) - 1


def test_merges(spark):
    """The registered merges against a plain loop over the words' symbols."""
    got = sorted(entry.queries()["bpe_merges"](spark, DATA).collect())
    from quantrel.plans.texts import word_freq

    words = [([*r["tok"], "</w>"], r["freq"]) for r in word_freq(spark, DATA).collect()]
    for r in got:
        counts = {}
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                counts[p] = counts.get(p, 0) + n
        a, b = max(counts, key=lambda p: (counts[p], *(t.encode() for t in p)))
        assert (r["a"], r["b"]) == (a, b)
        merged = []
        for w, n in words:
            out = []
            for t in w:
                if t == b and out and out[-1] == a:
                    out[-1] = a + b
                else:
                    out.append(t)
            merged.append((out, n))
        words = merged
