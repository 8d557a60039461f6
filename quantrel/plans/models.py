"""Queries of linear models and generative classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantrel.operators import bayes
from quantrel.operators import linear as lin
from quantrel.operators.metrics import pinned
from quantrel.sources import table, vectors

from . import unrolled
from .registry import query

X3 = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_simple(spark, d):
    r = lin.ols(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(r["coef"][1]), 6), round(float(r["coef"][0]), 4), round(float(r["r2"]), 6))], "slope double, intercept double, r2 double")


@query("SELECT " + ", ".join(f"round(sum({a} * {b}), 4) AS m_{i}_{j}" for i, a in enumerate(["1.0::DOUBLE", *X3, "l_extendedprice / 1000"]) for j, b in enumerate(["1.0::DOUBLE", *X3, "l_extendedprice / 1000"]) if i <= j) + " FROM lineitem")
def ols_gram(spark, d):
    t = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    return pinned(t.agg(*lin.gram_columns([*X3, "y"])), 4)


@query("""WITH c AS (SELECT l_quantity - avg(l_quantity) OVER () AS a, l_discount - avg(l_discount) OVER () AS b, l_extendedprice - avg(l_extendedprice) OVER () AS y FROM lineitem),
s AS (SELECT sum(a*a) + 100 AS aa, sum(a*b) AS ab, sum(b*b) + 100 AS bb, sum(a*y) AS ay, sum(b*y) AS byy FROM c)
SELECT round((ay * bb - byy * ab) / (aa * bb - ab * ab), 4) AS w_quantity, round((aa * byy - ab * ay) / (aa * bb - ab * ab), 4) AS w_discount FROM s""")
def ridge_closed(spark, d):
    w = lin.ridge(lin.gram(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"), 100.0)
    return spark.createDataFrame([(round(float(w[1]), 4), round(float(w[2]), 4))], "w_quantity double, w_discount double")


@query("""WITH c AS (SELECT l_quantity AS a, l_extendedprice AS y FROM lineitem), s AS (SELECT covar_pop(a, y) AS c, var_pop(a) AS v, avg(a) AS ma, avg(y) AS my FROM c)
SELECT round(sign(c) * greatest(abs(c) - 50, 0) / v, 4) AS slope, round(my - ma * sign(c) * greatest(abs(c) - 50, 0) / v, 4) AS intercept FROM s""")
def lasso_one_feature(spark, d):
    w = lin.elastic_net(lin.gram(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"), 50.0)
    return spark.createDataFrame([(round(float(w[1]), 4), round(float(w[0]), 4))], "slope double, intercept double")


@query(unrolled.shrinkage(X3, "l_extendedprice", [0.1, 1.0, 10.0, 100.0], 0.5))
def elastic_net_path(spark, d):
    m = lin.gram(table(spark, d, "lineitem"), X3, "l_extendedprice")
    rows = [(float(a), *(round(float(w), 6) + 0.0 for w in c)) for a, c in lin.path(m, [0.1, 1.0, 10.0, 100.0], 0.5)]
    return spark.createDataFrame(rows, "alpha double, intercept double, quantity double, discount double, tax double")


PENALTIES = [0.1, 10.0, 1000.0, 100000.0]


@query(unrolled.ridge_folds(X3, "l_extendedprice", PENALTIES, 5))
def ridge_cross_validation(spark, d):
    t = table(spark, d, "lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    r = lin.cross_validate(t, X3, "l_extendedprice", "fold", PENALTIES)
    return spark.createDataFrame([(float(a), *(round(v, 2) for v in e), r["best"], r["one_se"]) for a, e in r["errors"].items()], "alpha double, mse double, se double, best double, one_se double")


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n, avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem),
e AS (SELECT sum(pow(l_extendedprice - a - b * l_quantity, 2)) / (count(*) - 2) AS s2 FROM lineitem, s),
r AS (SELECT l_orderkey, l_linenumber, a + b * l_quantity AS fitted, 1 / n + pow(l_quantity - m, 2) / sxx AS h, l_extendedprice AS y, s2 FROM lineitem, s, e)
SELECT l_orderkey, l_linenumber, round(fitted, 3) AS fitted, round(h, 8) AS leverage, round((y - fitted) / sqrt(s2 * (1 - h)), 5) AS studentized, round(pow(y - fitted, 2) / (s2 * (1 - h)) * h / ((1 - h) * 2), 9) AS cooks_distance FROM r""")
def regression_diagnostics(spark, d):
    r = lin.diagnostics(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return r.select("l_orderkey", "l_linenumber", F.round("fitted", 3).alias("fitted"), F.round("leverage", 8).alias("leverage"), F.round("studentized", 5).alias("studentized"), F.round("cooks_distance", 9).alias("cooks_distance"))


@query(unrolled.newton())
def logistic_newton(spark, d):
    t = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    r = lin.logistic(t, ["l_discount", "l_tax"], "y", lam=1.0)
    return spark.createDataFrame([(n, *(round(float(r[c][i]), 6) for c in ("coef", "se", "odds_ratio", "low", "high"))) for i, n in enumerate(["intercept", "l_discount", "l_tax"])], "term string, coef double, se double, odds_ratio double, low double, high double")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(pow(l_quantity, 2), 4) AS p2, round(pow(l_quantity, 3), 4) AS p3, round(1.5 * pow(2 * (l_quantity - 1) / 49 - 1, 2) - 0.5, 6) AS q2, round(pow(greatest(l_quantity - 25, 0), 3), 4) AS t0 FROM lineitem""")
def basis_expansion(spark, d):
    q = "l_quantity"
    return pinned(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q, *(c for c in lin.truncated_power_basis(q, [25.0])[1:3]), lin.legendre_basis(q, 2, 1.0, 50.0)[1], lin.truncated_power_basis(q, [25.0])[3])).select("l_orderkey", "l_linenumber", q, F.round("p2", 4).alias("p2"), F.round("p3", 4).alias("p3"), F.round("q2", 6).alias("q2"), F.round("t0", 4).alias("t0"))


def first_four(spark, d):
    return vectors(spark, d).select("vec_id", "label", *(F.col("v")[i].alias(f"x{i}") for i in range(4)))


X4 = ["x0", "x1", "x2", "x3"]
FOUR = "(SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(4)) + " FROM embeddings)"
PARAMS = f"(SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS prior, {', '.join(f'avg({c}) AS mean_{c}' for c in X4)}, {', '.join(f'var_pop({c}) + 1e-9 * (SELECT greatest({', '.join(f'var_pop({k})' for k in X4)}) FROM {FOUR}) AS var_{c}' for c in X4)} FROM {FOUR} GROUP BY label)"


@query(f"SELECT label, round(prior, 6) AS prior, {', '.join(f'round(mean_{c}, 6) AS mean_{c}, round(var_{c}, 6) AS var_{c}' for c in X4)} FROM {PARAMS}")
def gaussian_nb_params(spark, d):
    return pinned(bayes.gaussian_parameters(first_four(spark, d), X4, "label"))


@query(f"""WITH j AS (SELECT vec_id, p.label AS c, ln(prior) {' '.join(f'- 0.5 * (ln(2 * pi() * var_{c}) + pow({c} - mean_{c}, 2) / var_{c})' for c in X4)} AS l FROM {FOUR} f, {PARAMS} p)
SELECT vec_id, arg_min(c, (-l, c)) AS predicted, round(max(l), 6) AS log_joint FROM j GROUP BY vec_id""")
def gaussian_nb_predict(spark, d):
    f = first_four(spark, d)
    return pinned(bayes.gaussian_predict(f, bayes.gaussian_parameters(f, X4, "label"), X4, "label", "vec_id"))


LABELLED = "(SELECT doc_id, quality, unnest(list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda x: x <> '')) AS tok FROM documents JOIN labels USING (doc_id))"


def labelled_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return docs, bayes.tokens(docs, "doc_id", "text", "quality")


NB = f"""WITH t AS (SELECT * FROM {LABELLED}), n AS (SELECT tok, quality, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT quality, sum(n) AS total FROM n GROUP BY 1), v AS (SELECT DISTINCT tok FROM n),
p AS (SELECT v.tok, c.quality, coalesce(n.n, 0) AS n, ln((coalesce(n.n, 0) + 1) / (c.total + (SELECT count(*) FROM v))) AS ll FROM v CROSS JOIN c LEFT JOIN n ON n.tok = v.tok AND n.quality = c.quality)"""


@query(f"{NB} SELECT tok, round(sum(CASE WHEN quality = 1 THEN ll ELSE -ll END), 6) AS log_odds FROM p GROUP BY tok")
def multinomial_nb_log_odds(spark, d):
    _, t = labelled_tokens(spark, d)
    p = bayes.multinomial_parameters(t, "quality")
    return pinned(p.groupBy("tok").agg(F.sum(F.when(F.col("quality") == 1, F.col("log_likelihood")).otherwise(-F.col("log_likelihood"))).alias("log_odds")))


@query(f"""{NB}, pr AS (SELECT quality, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM labels GROUP BY 1), s AS (SELECT doc_id, p.quality AS c, sum(tf * ll) + any_value(lp) AS l FROM (SELECT doc_id, tok, count(*) AS tf FROM t GROUP BY ALL) f JOIN p USING (tok) JOIN pr ON pr.quality = p.quality GROUP BY ALL)
SELECT doc_id, arg_min(c, (-l, c)) AS predicted, round(max(l), 4) AS log_joint FROM s GROUP BY doc_id""")
def multinomial_nb_predict(spark, d):
    docs, t = labelled_tokens(spark, d)
    n = docs.count()
    priors = docs.groupBy("quality").agg(F.ln(F.count(F.lit(1)) / n).alias("log_prior"))
    return pinned(bayes.multinomial_predict(t, bayes.multinomial_parameters(t, "quality"), priors, "doc_id", "quality"), 4)


@query(f"""WITH t AS (SELECT DISTINCT doc_id, quality, tok FROM {LABELLED}), c AS (SELECT quality AS c, count(*) AS docs FROM documents JOIN labels USING (doc_id) GROUP BY 1), n AS (SELECT tok, quality AS c, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT v.tok, c.c, (coalesce(n.n, 0) + 1) / (docs + 2) AS th FROM (SELECT DISTINCT tok FROM n) v CROSS JOIN c LEFT JOIN n ON n.tok = v.tok AND n.c = c.c), e AS (SELECT g.c, sum(ln(1 - th)) + any_value(ln(docs / (SELECT sum(docs) FROM c))) AS base FROM g JOIN c USING (c) GROUP BY g.c),
s AS (SELECT doc_id, g.c, sum(ln(th) - ln(1 - th)) + any_value(base) AS l FROM t JOIN g USING (tok) JOIN e ON e.c = g.c GROUP BY ALL) SELECT doc_id, arg_min(c, (-l, c)) AS predicted, round(max(l), 3) AS log_joint FROM s GROUP BY doc_id""")
def bernoulli_nb_predict(spark, d):
    docs, t = labelled_tokens(spark, d)
    return bayes.bernoulli_predict(t, docs, "doc_id", "quality").withColumn("log_joint", F.round("log_joint", 3))


@query()
def discriminant_analysis(spark, d):
    f = first_four(spark, d)
    out = f.select("vec_id", "label")
    for name, gamma in (("lda", 0.0), ("rda", 0.5), ("qda", 1.0)):
        out = out.join(bayes.discriminant_predict(f, bayes.discriminant(f, X4, "label", gamma), X4, "vec_id").select("vec_id", F.col("predicted").alias(name)), "vec_id")
    return out
