"""Operators against closed forms, brute force and each other."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantrel import functions as fn
from quantrel.operators import bayes, clustering, decision, graph, information, linear, metrics, neighbours, neural, optimize, ordered, reduction, rules, splits, statistics, text, trees, vision
from quantrel.sources import gridworld


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = 1 + x @ [2.0, -1.0, 0.5] + 0.1 * rng.normal(size=300)
    flag = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    pdf = pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "flag": flag, "score": np.round(x[:, 0], 1)})
    return pdf, spark.createDataFrame(pdf).cache()


X = ["a", "b", "c"]


def test_auc_counts_pairs(rows):
    pdf, df = rows
    p, n = pdf[pdf.flag == 1].score.to_numpy(), pdf[pdf.flag == 0].score.to_numpy()
    want = ((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean()
    assert metrics.roc_auc(df, "flag", "score").first()["auc"] == pytest.approx(want, abs=1e-12)


def test_running_totals_over_buckets(rows):
    pdf, df = rows
    got = {r["id"]: r["s"] for r in ordered.running_totals(df, "score", {"s": "y"}, ties=("id",)).collect()}
    want = pdf.sort_values(["score", "id"]).set_index("id").y.cumsum()
    assert all(got[i] == pytest.approx(v) for i, v in want.items())
    folds = splits.kfold(df.select("id"), "id", 7).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} <= {42, 43}


def test_degenerate_metrics_are_zero(spark):
    one = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = metrics.from_confusion(metrics.confusion(one, "y", "p")).first()
    assert (r["precision"], r["recall"], r["mcc"], r["kappa"]) == (0, 0, 0, 0)
    assert metrics.roc_auc(one, "y", "p").first()["auc"] is None


def test_least_squares(rows):
    pdf, df = rows
    m = np.column_stack([np.ones(300), pdf[X]])
    r = linear.ols(df, X, "y")
    assert np.allclose(r["coef"], np.linalg.lstsq(m, pdf.y, rcond=None)[0])
    assert r["r2"] > 0.99 and max(r["p"][1:]) < 1e-6
    h = linear.diagnostics(df, X, "y").agg(F.sum("leverage")).first()[0]
    assert h == pytest.approx(4)
    g = linear.gram(df, X, "y")
    assert np.allclose(linear.ridge(g, 0.0), r["coef"])
    assert np.allclose(linear.elastic_net(g, 0.2), linear.lasso_proximal(g, 0.2), atol=1e-6)
    assert np.allclose(linear.elastic_net(g, 100.0)[1:], 0)
    cv = linear.cross_validate(splits.hashed_fold(df, 5, "id"), X, "y", "fold", [0.01, 1.0, 1e4])
    assert cv["best"] < 1e4 <= 1e4 and cv["one_se"] >= cv["best"]
    assert np.allclose(linear.project_simplex(np.array([0.9, 0.9, -1.0])), [0.5, 0.5, 0])


def test_logistic_is_stationary(rows):
    _, df = rows
    w = linear.logistic(df, X, "flag", lam=1.0)["coef"]
    f = optimize.logistic_objective(df, X, "flag", 0.0)
    g = f(w)[1] + np.append(0, w[1:]) / 300
    assert np.abs(g).max() < 1e-8
    v = optimize.lbfgs(optimize.logistic_objective(df, ["a"], "flag", 0.1), np.zeros(2), rounds=20)
    assert np.linalg.norm(optimize.logistic_objective(df, ["a"], "flag", 0.1)(v)[1]) < 1e-6


def test_optimizers():
    f = optimize.rosenbrock()
    assert optimize.gradient_error(f, np.array([-1.2, 1.0])) < 1e-6
    assert np.allclose(optimize.lbfgs(f, np.array([-1.2, 1.0])), 1, atol=1e-5)
    q = optimize.quadratic(np.diag([1.0, 10.0]), np.array([1.0, 10.0]))
    for rule in optimize.Stepper.RULES:
        x, _ = optimize.descend(q, np.zeros(2), optimize.Stepper(rule, 0.05 if rule != "adagrad" else 0.5), 3000)
        assert np.allclose(x, 1, atol=0.05), rule
    best, value = optimize.bayes_optimize(lambda v: float((v[0] - 0.3) ** 2), np.array([0.0]), np.array([1.0]), rounds=8)
    assert value < 1e-3
    assert optimize.successive_halving([1, 5, 3], lambda c, b: c * b, [1, 2]) == (5, 5)


def test_bases(spark):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(0, 1, 21)], "x double")
    b = np.array(df.select(*linear.bspline_basis("x", [0.3, 0.6], 0.0, 1.0)).collect())
    assert b.shape == (21, 6) and np.allclose(b.sum(1), 1)
    n = np.array(df.select(*linear.natural_cubic_basis("x", [0.2, 0.4, 0.6])).collect())
    assert np.allclose(np.diff(n[16:], 2, axis=0), 0, atol=1e-9)


def test_tails():
    assert statistics.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert statistics.two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert statistics.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert statistics.mcnemar_exact(0, 0) == 1 and statistics.mcnemar_exact(1, 9) == pytest.approx(22 / 1024)


def test_erf(spark):
    xs = [-5.0, -2.0, -0.5, 0.0, 0.1, 1.0, 3.0, 3.9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(fn.erf(F.col("x"))).collect()]
    assert np.allclose(got, [math.erf(x) for x in xs], atol=1e-7)


def test_information():
    codes = information.huffman({"a": 5, "b": 2, "c": 1, "d": 1})
    assert sorted(map(len, codes.values())) == [1, 2, 3, 3]
    p = information.max_entropy(6, [1, 2, 3, 4, 5, 6], 3.5)
    assert np.allclose(p, 1 / 6)


def test_text_golden(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the cat sat on the mat", "the cat sat on mat"), (3, "a b", "c d")], "id long, r string, h string")
    got = {r["id"]: r["bleu"] for r in text.bleu(df, "id", "r", "h").collect()}
    assert got[1] == 1 and got[3] == 0 and 0.4 < got[2] < 0.7
    lcs = [r[0] for r in df.orderBy("id").select(text.rouge_l(F.col("r"), F.col("h"))).collect()]
    assert lcs == pytest.approx([1, 5 / 6, 0])
    qa = spark.createDataFrame([(1, "Eiffel Tower.", "the Eiffel Tower"), (2, "", "")], "id long, p string, g string")
    assert {r["id"]: round(r["f1"], 2) for r in text.answer_scores(qa, "id", "p", "g").collect()} == {1: 0.8, 2: 0.0}
    pairs = spark.createDataFrame([("running", "runnign"), ("running", "runner"), ("running", "jumping"), ("king", "kings")], "a string, b string")
    assert [round(r[0], 3) for r in pairs.select(text.jaccard(text.char_ngrams(F.col("a")), text.char_ngrams(F.col("b")))).collect()] == [0.4, 0.3, 0.167, 0.5]
    tf = text.counted(spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a c", "a b", "a"])], "d long, t string"), "d", text.words(F.col("t")))
    assert tf.count() == 7


def test_merges(spark):
    words = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "w string, n long")
    got = text.learn_merges(words, "w", "n", 3)
    assert got[:2] == [("s", "t"), ("st", "</w>")] or got[:2] == [("t", "</w>"), ("s", "t</w>")]
    ranks = {p: i for i, p in enumerate(got)}
    assert text.decode_symbols(text.encode_word("lowest", ranks)) == "lowest"


def test_spans(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("B-PER I-PER O B-LOC I-PER B-LOC".split())], "s long, p int, t string")
    got = {tuple(r)[1:] for r in text.spans_from_bio(df, "s", "p", "t").collect()}
    assert got == {("PER", 0, 2), ("LOC", 3, 4), ("LOC", 5, 6)}


def test_itemsets_against_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(1)
    baskets = [sorted(rng.choice(list("abcdefg"), rng.integers(2, 5), replace=False)) for _ in range(80)]
    df = spark.createDataFrame([(i, str(x)) for i, b in enumerate(baskets) for x in b], "b long, i string")
    got = {tuple(r["items"]): r["n"] for r in rules.frequent_itemsets(df, "b", "i", 0.1).collect()}
    want = {}
    for k in (1, 2, 3):
        for s in combinations("abcdefg", k):
            n = sum(set(s) <= set(map(str, b)) for b in baskets)
            if n >= 8:
                want[s] = n
    assert got == want


def test_trees(rows):
    pdf, df = rows
    t = trees.classification_tree(df, X, "flag", [0, 1], depth=1)
    assert t.nodes[0][0] == "a"
    t = trees.regression_tree(df, X, "y", depth=3, least=5)
    means = df.groupBy(t.column(what="node").alias("n"), t.column().alias("v")).agg(F.avg("y").alias("m")).collect()
    assert all(r["v"] == pytest.approx(r["m"]) for r in means) and len(means) > 4
    risk = {i: 1.0 for i in t.nodes}
    t.prune(10.0, risk)
    assert t.leaves() == [0]
    b = trees.boosted(df, X, "flag", "logistic", rounds=3, depth=2)
    wrong = df.agg(F.avg(((trees.margin(b, 0.3) > 0).cast("int") != F.col("flag")).cast("double"))).first()[0]
    assert wrong < 0.2
    m = trees.adaboost(df.withColumn("s", 2 * F.col("flag") - 1), X, "s", 2)
    assert m[0][1] == "a" and m[0][0] > 0


def test_split_tables_by_buckets(rows):
    """Bucketed and plain split tables agree, so do the trees grown from them."""
    _, df = rows
    counts = trees.value_counts(df.withColumn("node", F.col("flag") + 1), X, {"n": F.lit(1).cast("long"), "s": F.col("y")}, "node")
    seen = [sorted((r["node"], r["feature"], r["value"], r["after"], r["threshold"], r["l_n"], r["t_n"], round(r["l_s"], 6), round(r["t_s"], 6)) for r in trees.split_table(counts, ["n", "s"], "node", w).collect()) for w in (False, True)]
    assert seen[0] and seen[0] == seen[1]
    plain, trees.ONE_GROUP = trees.regression_tree(df, X, "y", depth=2), 0
    try:
        assert {i: n[:2] for i, n in trees.regression_tree(df, X, "y", depth=2).nodes.items()} == {i: n[:2] for i, n in plain.nodes.items()}
    finally:
        trees.ONE_GROUP = 100_000


def test_neighbours_and_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, size=(20, 2)) for m in ((0, 0), (3, 0), (0, 3))])
    df = spark.createDataFrame([(i, v.tolist(), i // 20) for i, v in enumerate(x)], "id long, v array<double>, label int").cache()
    near = neighbours.knn(df.where("id % 7 = 0"), df, "id", "v", 3).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in near:
        assert r["d"] == pytest.approx(np.sort(d[r["q"]])[r["rank"]])
    assert neighbours.silhouette(df, "id", "v", "label").agg(F.avg("s")).first()[0] > 0.9
    centres, inertia = clustering.kmeans(df, "id", "v", 3, rounds=5)
    assert inertia < 3
    found = {r["id"]: r["cluster"] for r in clustering.dbscan(df, "id", "v", 0.5, 4).collect()}
    assert {found[i] for i in range(20)} == {0} and found[25] == 20
    links = clustering.agglomerate(x)
    assert len(set(clustering.cut_tree(links, 60, 3)[:20])) == 1 and clustering.cophenetic_correlation(x, links) > 0.8
    emb = clustering.spectral_embedding(clustering.affinity(x, 1.0), 3)
    assert emb.shape == (60, 3)
    lof = {r["id"]: r["lof"] for r in neighbours.local_outlier_factor(df.union(spark.createDataFrame([(99, [9.0, 9.0], 0)], df.schema)), "id", "v", 5).collect()}
    assert max(lof, key=lof.get) == 99
    assert reduction.tsne(x, rounds=20).shape == (60, 2) and reduction.isomap(x[:20], 2, 5).shape == (20, 2)
    with pytest.raises(ValueError, match="at most"):
        clustering.bounded(df, "id", "v", 10)


def test_components(spark):
    v = spark.createDataFrame([(i,) for i in range(8)], "k long")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {r["k"]: r["component"] for r in graph.components(v, e, "k").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}


def test_reduction(rows):
    pdf, df = rows
    m = reduction.pca(df, X, 2)
    want = np.linalg.svd(pdf[X] - pdf[X].mean(), compute_uv=False) ** 2 / 299
    assert np.allclose(m["variance"], want[:2])
    r = reduction.tall_qr(df, X)
    assert np.allclose(r.T @ r, pdf[X].T @ pdf[X])
    assert np.allclose(reduction.singular_values(df, X), np.linalg.svd(pdf[X], compute_uv=False))
    assert reduction.power_iteration(np.diag([3.0, 1.0]))[0] == pytest.approx(3)
    s = {r["id"]: r["score"] for r in reduction.isolation_scores(df, "id", X, trees=10, sample=64).collect()}
    assert all(0 < v < 1 for v in s.values())
    q = bayes.discriminant_predict(df, bayes.discriminant(df, X, "flag"), X, "id").join(df, "id").agg(F.avg((F.col("predicted") == F.col("flag")).cast("double"))).first()[0]
    assert q > 0.85
    mix = clustering.mixture(df, ["a"], [[-1.0], [1.0]], rounds=5)
    assert sum(w for w, _, _ in mix["model"]) == pytest.approx(1)


def test_network_gradients(rows):
    pdf, df = rows
    for loss, y in (("softmax", pdf.flag.to_numpy()), ("squared", pdf[["y"]].to_numpy())):
        net = neural.Network([3, 4, 2 if loss == "softmax" else 1], "tanh", "glorot", loss, 1)
        start = net.flat()

        def value(v, net=net, y=y):
            net.load(v)
            return net.gradient(pdf[X].to_numpy()[:20], y[:20])[0]

        want = optimize.numerical_gradient(value, start)
        net.load(start)
        assert np.allclose(net.gradient(pdf[X].to_numpy()[:20], y[:20])[1], want, atol=1e-4)
    net = neural.Network([3, 4, 2], seed=0)
    seen = neural.train(df, X, ["flag"], net, rounds=5)
    assert seen[-1] < seen[0]
    assert len(neural.apply(df, X, net, "id").first()["out"]) == 2


def test_cells_and_flows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 3))
    assert neural.rnn(x, rng.normal(size=(3, 2)), np.eye(2), np.zeros(2)).shape == (6, 2)
    assert neural.lstm(x, rng.normal(size=(3, 8)), rng.normal(size=(2, 8)), np.zeros(8)).shape == (6, 2)
    assert neural.gru(x, rng.normal(size=(3, 6)), rng.normal(size=(2, 6)), np.zeros(6), np.zeros(6)).shape == (6, 2)
    layers = [neural.Coupling(np.array([1.0, 0.0]), 0), neural.Coupling(np.array([0.0, 1.0]), 1)]
    z = v = rng.normal(size=(5, 2))
    for layer in layers:
        z, _ = layer.forward(z)
    for layer in reversed(layers):
        z = layer.inverse(z)
    assert np.allclose(z, v)
    assert neural.latent_divergence(np.zeros((1, 2)), np.zeros((1, 2)))[0] == 0
    y = np.where(x[:, 0] > 0, 1, -1)
    assert (np.sign(np.column_stack([np.ones(6), x]) @ neural.perceptron(x, y)) == y).all()
    a, b = neural.support_vectors(x, y, x @ x.T, 100.0)
    assert (np.sign(x @ x.T @ (a * y) + b) == y).all()
    beta, c = neural.support_regression(x @ x.T, x[:, 0], 10.0, 0.01)
    assert np.abs(x @ x.T @ beta + c - x[:, 0]).mean() < 0.3


def test_worlds(spark):
    g = gridworld(spark)
    v = {r["s"]: r["v"] for r in decision.value_iteration(g, 1.0, most=12).collect()}
    assert v[0] == -6 and v[14] == -1 and v[15] == 0
    b = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    assert b.select(vision.iou("a", "b")).first()[0] == pytest.approx(25 / 175)
    assert decision.compute_optimal(spark, 1e18).first()["loss"] == pytest.approx(3.535, abs=1e-3)
    assert [round(r["alpha_bar"], 3) for r in decision.diffusion_schedule(spark).where("t in (10, 39)").orderBy("t").collect()] == [0.806, 0.042]


def test_isotonic_fit(spark, rows):
    from quantrel.operators import calibration

    pdf, df = rows
    blocks = calibration.isotonic(df, "score", "flag")
    values = [m for _, _, m in blocks]
    assert values == sorted(values) and all(a[1] < b[0] for a, b in zip(blocks, blocks[1:], strict=False))
    by = pdf.groupby("score").flag.agg(["mean", "size"]).reset_index()
    want = calibration.pool_adjacent(by["mean"].to_numpy(), by["size"].to_numpy(float))
    assert np.allclose(values, [m for m, *_ in want])
    got = calibration.calibrate(df, "score", blocks).agg(F.avg("calibrated")).first()[0]
    assert got == pytest.approx(pdf.flag.mean())


def test_smoothing_and_stacking(rows):
    pdf, df = rows
    s = linear.smoothing_spline(df.withColumn("z", F.sin(2 * F.col("a"))), "a", "z")
    assert s["gcv"] < 0.02 and 3 < s["dof"] < 11
    r = linear.stack(splits.hashed_fold(df, 5, "id"), {"good": ["a", "b", "c"], "bad": ["c"]}, "y", "fold")
    assert r["weights"]["good"] > 0.95 and sum(r["weights"].values()) == pytest.approx(1)
