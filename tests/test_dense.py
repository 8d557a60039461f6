"""Every query with every row by tiles: pieces and cuts of any size give what brute force gives, and no pair is shuffled."""

import numpy as np
import pytest

from quantrel.operators import dense


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (90, 6)).astype(np.float32).astype(float)
    x[40:70] = x[40]  # a third of all rows are one point
    return x, spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "id long, v array<double>").cache()


@pytest.fixture(params=[(7, 11, 4), (4096, 1024, 256)])
def sizes(request, monkeypatch):
    for name, value in zip(("QUERIES", "ROWS", "CUT"), request.param, strict=True):
        monkeypatch.setattr(dense, name, value)


def weights(x, causal=False):
    s = x @ x.T * 2
    if causal:
        s[np.triu_indices(len(x), 1)] = -np.inf
    e = np.exp(s - s.max(1)[:, None])
    return e / e.sum(1)[:, None]


def operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attention_values(points, sizes):
    x, rows = points
    got = dense.softmax_values(dense.softmax_states(rows, rows, "id", "v", 2.0, values=True))
    assert {(r["q"], r["p"]): round(r["x"], 9) + 0.0 for r in got.collect()} == {(q, p): round(float(t), 9) + 0.0 for (q, p), t in np.ndenumerate(weights(x) @ x)}


def test_null_vectors(spark, sizes):
    rows = spark.createDataFrame([(0, None), (1, [1.0, 2.0]), (2, [1.0, None]), (3, [0.5, 1.0])], "id long, v array<double>")
    got = {(r["q"], r["p"]): r["x"] for r in dense.softmax_values(dense.softmax_states(rows, rows, "id", "v", 1.0, values=True)).collect()}
    e = np.exp([5.0, 2.5])
    assert round(got[1, 0], 9) == round(float(e @ [1, 0.5] / e.sum()), 9) and got.get((0, 0)) is None and got.get((2, 1)) is None


def test_online_softmax_shuffles_no_scores(spark):
    """The plan met every query with every row in a join and shuffled a row for each place of each pair."""
    from quantrel.plans import vectors

    plan = operators(vectors.online_softmax_attention(spark, "/root/testdata/sf0.001"))
    assert "FlatMapGroupsInArrow" in plan and "<= q#" not in plan and "iv#" not in plan


def test_shortlists_hold_the_best_by_either_score(points, sizes):
    x, rows = points
    got = [(r["q"], r["i"], r["cheap"], r["exact"]) for r in dense.shortlists(rows.where("id % 3 = 0"), rows, "id", "v", 2, 5).collect()]
    assert len({g[:2] for g in got}) == len(got)
    for c, n in ((2, 2), (3, 6)):
        for q in range(0, 90, 3):
            s = [sum((x[q, j] * x[i, j] for j in range(n)), 0.0) for i in range(90)]
            want = sorted((-s[i], i) for i in range(90) if i != q)[:5]
            assert sorted((-g[c], g[1]) for g in got if g[0] == q)[:5] == want


def test_retrieve_rerank_joins_no_pairs(spark):
    """Every query met every row in a nested loop, and both rankings ran over all pairs."""
    from quantrel.operators import retrieval
    from quantrel.plans import retrieval as plans

    seen, real = [], retrieval.retrieve_then_rerank
    plans.rt.retrieve_then_rerank = lambda s, *a: seen.append(s) or real(s, *a)
    try:
        plans.retrieve_rerank(spark, "/root/testdata/sf0.001")
    finally:
        plans.rt.retrieve_then_rerank = real
    assert seen[0].count() <= 25 * 40 < 25 * 499


def brute(x, score):
    return {(q, i): tuple(round(float(t), 6) + 0.0 for t in score(x[q], x[i])) for q in range(len(x)) for i in range(len(x))}


def test_kernels_of_all_pairs(points, sizes):
    x, rows = points
    names = ["linear", "poly", "rbf", "laplacian", "sigmoid"]
    got = {(r["q"], r["i"]): tuple(r[n] for n in names) for r in dense.pair_scores(rows, rows, "id", "v", dense.kernels, names, 6, same=True).collect()}
    want = brute(x, lambda a, b: (a @ b, (0.5 * a @ b + 1) ** 3, np.exp(-0.5 * ((a - b) ** 2).sum()), np.exp(-0.5 * np.abs(a - b).sum()), np.tanh(0.5 * a @ b + 1)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in want)


@pytest.mark.parametrize("name", ["kernel_matrix", "pairwise_metrics", "causal_attention_weights", "attention_weights"])
def test_pairs_come_from_tiles(spark, name):
    """Vectors of both sides were joined and went through array lambdas, pair by pair."""
    from quantrel.plans import vectors

    plan = operators(getattr(vectors, name)(spark, "/root/testdata/sf0.001"))
    assert "FlatMapGroupsInArrow" in plan and "iv#" not in plan and "zip_with" not in plan


def test_rounding_and_null_pairs(spark, sizes):
    assert list(dense.rounded(np.array([0.5, 1.5, -0.5, -0.2, np.inf, 0.49999999999999994]), 0)) == [1, 2, -1, 0, np.inf, 0]
    rows = spark.createDataFrame([(0, None), (1, [1.0, 2.0]), (None, [0.5, 1.0])], "id long, v array<double>")
    got = {(r["q"], r["i"]): r["s"] for r in dense.pair_scores(rows.where("id >= 0"), rows, "id", "v", lambda x, y: [dense.dots(x, y)], ["s"], 6, same=True).collect()}
    assert got == {(0, 0): None, (0, 1): None, (0, None): None, (1, 0): None, (1, 1): 5.0, (1, None): 2.5}


def test_distances_of_all_pairs(points, sizes):
    x, rows = points
    names = ["euclidean", "manhattan", "chebyshev", "minkowski", "cosine", "hamming"]
    got = {(r["q"], r["i"]): tuple(r[n] for n in names) for r in dense.pair_scores(rows, rows, "id", "v", dense.distances, names, 6).collect()}
    gap = lambda a, b: np.abs(a - b)
    want = brute(x, lambda a, b: (np.sqrt((gap(a, b) ** 2).sum()), gap(a, b).sum(), gap(a, b).max(), (gap(a, b) ** 3).sum() ** (1 / 3), 1 - a @ b / np.sqrt(a @ a * (b @ b)), (gap(a, b) > 0).mean()))
    want = {k: w for k, w in want.items() if k[0] != k[1]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in want)


@pytest.mark.parametrize("causal", [False, True])
def test_attention_weights(points, sizes, causal):
    x, rows = points
    w = weights(x, causal)
    got = {(r["q"], r["i"]): r["weight"] for r in dense.softmax_weights(rows, rows, "id", "v", 2.0, 8, causal).collect()}
    want = {(q, i): float(t) for (q, i), t in np.ndenumerate(w) if i <= q or not causal}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-8) for k in want)


@pytest.mark.parametrize("queries, rows", [(5_129, 102_564), (102_564, 102_564), (1_000_000, 1_000_000), (40, 5_000_000)])
def test_pieces_bound_the_copies(queries, rows):
    """Each of 5,129 queries was shuffled 101 times to meet 102,564 rows."""
    nq, nr = dense.pieces(queries, rows)
    assert queries <= nq * dense.WIDEST and rows <= nr * dense.WIDEST * 2
    assert (queries * nr + rows * nq) / (queries + rows) <= max(8, 2 * max(queries, rows) / dense.WIDEST)
    assert nq * nr >= 48 or queries < 4096


def test_online_softmax_attention_answers_every_row(spark):
    """Only rows whose id is divisible by 20 were answered."""
    from quantrel.plans import vectors

    rows = vectors.vectors(spark, "/root/testdata/sf0.001").collect()
    x = np.array([r["v"] for r in rows])
    s = np.exp(x @ x.T / 8)
    want = s @ x / s.sum(1)[:, None]
    got = {(r["q"], r["p"]): r["x"] for r in vectors.online_softmax_attention(spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx({(r["vec_id"], p): want[k, p] for k, r in enumerate(rows) for p in range(64)}, abs=1.1e-6)


def test_best_of_ties_and_nulls():
    """Equal vectors, far more than k, go by id; pairs with a null vector come last."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (700, 7))
    x[100:600] = x[100]
    whole = np.arange(700) % 50 != 3
    x[~whole] = np.nan
    s = dense.Side(pa.array(np.arange(700)), x, whole, [])
    for k, n in ((5, 700), (20, 700), (20, 18)):
        rows = s.part(slice(0, n))
        got = np.divmod(dense.best(s.part(slice(0, 200)), rows, 7, k), n)
        exact = dense.dots(x[:200], x[:n])
        want = [(q, i) for q in range(200) for i in sorted((i for i in range(n) if i != q), key=lambda i: (not (whole[q] and whole[i]), -exact[q, i] if whole[q] and whole[i] else 0, i))[:k]]
        assert list(zip(*got, strict=True)) == want


def test_retrieve_rerank_asks_every_row(spark):
    """Only rows whose id is divisible by 20 were queries."""
    from quantrel.operators import retrieval
    from quantrel.plans import retrieval as plans

    seen, real = [], retrieval.retrieve_then_rerank
    plans.rt.retrieve_then_rerank = lambda s, *a: seen.append(s) or real(s, *a)
    try:
        plans.retrieve_rerank(spark, "/root/testdata/sf0.001")
    finally:
        plans.rt.retrieve_then_rerank = real
    assert seen[0].select("q").distinct().count() == 500 and seen[0].count() <= 500 * 40


def test_causal_attention_weights_of_every_row(spark):
    """Only rows whose id is divisible by 20 had weights."""
    from quantrel.plans import vectors

    rows = vectors.vectors(spark, "/root/testdata/sf0.001").collect()
    x, ids = np.array([r["v"] for r in rows]), np.array([r["vec_id"] for r in rows])
    s = np.where(ids <= ids[:, None], np.exp(x @ x.T / 8), 0)
    want = s / s.sum(1)[:, None]
    got = {(r["q"], r["i"]): r["weight"] for r in vectors.causal_attention_weights(spark, "/root/testdata/sf0.001").collect()}
    want = {(int(ids[a]), int(ids[b])): float(w) for (a, b), w in np.ndenumerate(want) if ids[b] <= ids[a]}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1.1e-8
