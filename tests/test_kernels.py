"""Small dense kernels and operators over any estimator against numpy and brute force."""

import hashlib
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrel import functions as fn
from quantrel.operators import ensembles, linalg, ordered, retrieval, statistics, text


def test_factorisations():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(7, 4))
    for modified in (True, False):
        q = linalg.gram_schmidt(a, modified)
        assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(q @ q.T @ a, a)
    s = a.T @ a
    values, vectors = linalg.symmetric_eig(s)
    assert np.allclose(values, np.linalg.eigvalsh(s)[::-1]) and np.allclose(s @ vectors, vectors * values)
    assert np.allclose(linalg.cholesky(s), np.linalg.cholesky(s))
    b = rng.normal(size=4)
    assert np.allclose(linalg.eliminate(s, b), np.linalg.solve(s, b))
    for m in (a, a.T, np.outer(a[:, 0], b), np.concatenate([a, a[:, :1]], 1)):
        assert np.allclose(linalg.pinv(m), np.linalg.pinv(m), atol=1e-6) and linalg.matrix_rank(m) == np.linalg.matrix_rank(m)
    u, d, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(linalg.low_rank(a, 2), u[:, :2] * d[:2] @ vt[:2]) and linalg.condition_number(a) == pytest.approx(np.linalg.cond(a))
    assert linalg.condition_number(np.ones((2, 2))) == float("inf") and np.allclose(linalg.project(a) @ a, a)
    with pytest.raises(ValueError):
        linalg.cholesky(-s)
    with pytest.raises(ValueError):
        linalg.eliminate(np.zeros((2, 2)), np.ones(2))


def test_conditional_normal():
    mean, cov = np.array([1.0, 2.0, 3.0]), np.array([[2.0, 0.5, 0.3], [0.5, 1.0, 0.2], [0.3, 0.2, 1.5]])
    m, c = linalg.conditional_normal(mean, cov, [0], np.array([2.0]))
    assert np.allclose(m, [2.25, 3.15]) and np.allclose(c, [[1 - 0.125, 0.2 - 0.075], [0.2 - 0.075, 1.5 - 0.045]])


def test_neighbour_tree_is_exact():
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(400, 3)), 1)
    tree = linalg.NeighbourTree(points, 8)
    for q in np.round(rng.normal(size=(40, 3)), 1):
        want = sorted((float(np.linalg.norm(p - q)), i) for i, p in enumerate(points))[:7]
        assert tree.search(q, 7) == want
    assert len(linalg.NeighbourTree(np.ones((50, 2)), 4).search(np.zeros(2), 3)) == 3


def test_bags_and_blends(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(3 * x + rng.normal())) for i, x in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    make = lambda: ensembles.Linear(("x",), "y")
    models = ensembles.bag(df, make, 6, "k")
    assert len({round(float(m.coef[1]), 9) for m in models}) == 6 and all(abs(m.coef[1] - 3) < 0.3 for m in models)
    got = ensembles.bagged(df, models, "p", "k")
    row = got.agg(F.avg(ensembles.copies(0, "k").cast("double")), F.count("p_oob")).first()
    assert abs(row[0] - 1) < 0.15 and 400 < row[1] < 500
    assert min(ensembles.cross_val_score(df.withColumn("f", F.col("k") % 4), "f", [0, 1, 2, 3], make, ensembles.r2_score("y"))) > 0.8
    predict = ensembles.blend(df, fn.hashed_uniform(F.col("k")) < 0.2, [make(), ensembles.Linear((), "y")], lambda n: ensembles.Linear(n, "y"))
    assert ensembles.r2_score("y")(predict(df, "p"), "p") > 0.8


def test_ordered_and_odd_inputs(spark):
    df = spark.createDataFrame([(i, i % 3, float((i * 7) % 11)) for i in range(60)], "k long, g long, x double")
    got = {r["k"]: r["low"] for r in ordered.running_minimum(df, "k", "x", "low").collect()}
    assert all(got[i] == min(float((j * 7) % 11) for j in range(i + 1)) for i in range(60))
    assert ordered.running_minimum(df.limit(0), "k", "x", "low").collect() == []
    m = {r["k"]: r["m"] for r in ordered.exponential_moving(df, "g", ("k",), "x", 0.5, "m").collect()}
    state = {}
    for i in range(60):
        state[i % 3] = 0.5 * state.get(i % 3, 0.0) + 0.5 * float((i * 7) % 11)
        assert m[i] == pytest.approx(state[i % 3])
    finite = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in finite.select(fn.is_finite(F.col("x"))).collect()] == [True, False, False, False, False]
    assert statistics.permutation_test(df, "x", F.lit(True), "k", rounds=5).first()["p"] is None
    docs = spark.createDataFrame([(1, []), (2, ["a", "b", "c", "d"])], "d long, w array<string>")
    spans = {r["d"]: r for r in text.span_corruption(docs, "d", "w", rate=1.0).collect()}
    assert (spans[1]["source"], spans[2]["source"], spans[2]["target"], spans[2]["n_masked"]) == ("", "<0> <1>", "<0> a b c <1> d", 4)


def test_precision_by_stage(spark):
    scored = spark.createDataFrame([(0, i, float(-i), float(i)) for i in range(10)], "q long, i long, cheap double, exact double")
    found = retrieval.retrieve_then_rerank(scored, "cheap", "exact", 4)
    assert {(r["i"], r["r1"], r["r2"]) for r in found.collect()} == {(0, 1, 4), (1, 2, 3), (2, 3, 2), (3, 4, 1)}
    got = retrieval.precision_at(found, spark.createDataFrame([(0, 3)], "q long, i long"), [1, 2])
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, 0.0, 1.0), (2, 0.0, 0.5)]


@pytest.mark.parametrize("deviations", [6, 0])
def test_permutations_against_sorting(spark, monkeypatch, deviations):
    """Group sizes hold where keys repeat, which a cut at a hash could not split, and where the cut lies outside of what is ranked at first."""
    monkeypatch.setattr(statistics, "DEVIATIONS", deviations)
    rows = [(i // 3, float(i * 7919 % 101), i % 4 == 0) for i in range(60)]
    u = lambda r, k: int(hashlib.md5(f"0:{r}:{k}".encode()).hexdigest()[:12], 16) / 2**48
    gap = lambda a, b: sum(a) / len(a) - sum(b) / len(b)
    observed, n = gap([v for _, v, a in rows if a], [v for _, v, a in rows if not a]), sum(a for *_, a in rows)
    each = [[v for *_, v in sorted((u(r, k), k, v) for k, v, _ in rows)] for r in range(1, 41)]
    want = (sum(abs(gap(s[:n], s[n:])) >= abs(observed) for s in each) + 1) / 41
    got = statistics.permutation_test(spark.createDataFrame(rows, "k long, v double, a boolean"), "v", F.col("a"), "k", rounds=40).first()
    assert (got["p"], round(got["observed"], 9)) == (want, round(observed, 9))
    one = spark.createDataFrame([(1, 0.0, False), (1, 0.0, False), (1, 0.0, False), (1, 3.0, True)], "k long, v double, a boolean")
    assert statistics.permutation_test(one, "v", F.col("a"), "k", rounds=5).first()["p"] == pytest.approx(1 / 6)
