"""Queries over embeddings: neighbours, clusters, reduction, outliers, attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantrel import functions as fn
from quantrel.operators import clustering as cl
from quantrel.operators import dense
from quantrel.operators import neighbours as nn
from quantrel.operators import reduction as red
from quantrel.operators.metrics import pinned
from quantrel.sources import vectors

from .models import FOUR, X4, first_four
from .registry import query

E = "(SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
METRICS = {
    "euclidean": "list_distance(q.v, i.v)", "manhattan": "list_sum(list_transform(list_zip(q.v, i.v), lambda z: abs(z[1] - z[2])))", "chebyshev": "list_max(list_transform(list_zip(q.v, i.v), lambda z: abs(z[1] - z[2])))",
    "minkowski": "pow(list_sum(list_transform(list_zip(q.v, i.v), lambda z: pow(abs(z[1] - z[2]), 3))), 1 / 3)", "cosine": "1 - list_cosine_similarity(q.v, i.v)", "hamming": "list_avg(list_transform(list_zip(q.v, i.v), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))",
}
#: The stated query set: every row whose id is divisible by 20, against all rows.
QUERY_ROWS = "vec_id % 20 = 0"


@query(f"SELECT q.vec_id AS q, i.vec_id AS i, {', '.join(f'round({s}, 6) AS {m}' for m, s in METRICS.items())} FROM {E} q, {E} i WHERE q.{QUERY_ROWS} AND q.vec_id <> i.vec_id")
def pairwise_metrics(spark, d):
    v = vectors(spark, d)
    return dense.pair_scores(v.where(QUERY_ROWS), v, "vec_id", "v", dense.distances, list(METRICS), 6)


KNN = f"(SELECT q, i, d, row_number() OVER (PARTITION BY q ORDER BY d, i) AS rank FROM (SELECT q.vec_id AS q, i.vec_id AS i, list_distance(q.v, i.v) AS d FROM {E} q, {E} i WHERE q.{QUERY_ROWS} AND q.vec_id <> i.vec_id) QUALIFY rank <= 5)"


def neighbours(spark, d, k=5):
    v = vectors(spark, d)
    return nn.knn(v.where(QUERY_ROWS), v, "vec_id", "v", k)


@query(f"SELECT q, i, round(d, 6) AS d, rank::INT AS rank FROM {KNN}")
def knn_topk(spark, d):
    return pinned(neighbours(spark, d))


@query(f"WITH c AS (SELECT q, label AS c, count(*) AS w FROM {KNN} k JOIN embeddings e ON e.vec_id = k.i GROUP BY ALL) SELECT q, arg_min(c, (-w, c)) AS predicted FROM c GROUP BY q")
def knn_classify(spark, d):
    return nn.vote(neighbours(spark, d), vectors(spark, d), "vec_id", "label")


@query(f"WITH c AS (SELECT q, label AS c, sum(1 / d) AS w FROM {KNN} k JOIN embeddings e ON e.vec_id = k.i GROUP BY ALL) SELECT q, arg_min(c, (-w, c)) AS predicted FROM c GROUP BY q")
def knn_classify_weighted(spark, d):
    return nn.vote(neighbours(spark, d), vectors(spark, d), "vec_id", "label", True)


@query(f"SELECT q, round(avg(v[1]), 6) AS predicted FROM {KNN} k JOIN {E} e ON e.vec_id = k.i GROUP BY q")
def knn_regress(spark, d):
    return pinned(nn.regress(neighbours(spark, d), vectors(spark, d).withColumn("y", F.col("v")[0]), "vec_id", "y"))


ALL_KNN = f"(SELECT q, i, d, row_number() OVER (PARTITION BY q ORDER BY d, i) AS rank FROM (SELECT q.vec_id AS q, i.vec_id AS i, list_distance(q.v, i.v) AS d FROM {E} q, {E} i WHERE q.vec_id <> i.vec_id) QUALIFY rank <= 10)"


@query(f"""WITH k AS (SELECT * FROM {ALL_KNN}), m AS (SELECT q, max(d) AS kd FROM k GROUP BY q), r AS (SELECT k.q, 1 / (avg(greatest(d, kd)) + 1e-12) AS lrd FROM k JOIN m ON m.q = k.i GROUP BY k.q)
SELECT k.q AS vec_id, round(avg(o.lrd) / (any_value(s.lrd) + 1e-12), 6) AS lof FROM k JOIN r o ON o.q = k.i JOIN r s ON s.q = k.q GROUP BY k.q""")
def lof_scores(spark, d):
    return pinned(nn.local_outlier_factor(vectors(spark, d), "vec_id", "v", 10))


@query(f"""WITH p AS (SELECT q.vec_id AS q, q.label AS lq, i.label AS li, avg(list_distance(q.v, i.v)) AS m FROM {E} q, {E} i WHERE q.vec_id <> i.vec_id GROUP BY ALL),
s AS (SELECT q, coalesce(max(m) FILTER (li = lq), 0) AS a, min(m) FILTER (li <> lq) AS b FROM p GROUP BY q) SELECT q AS vec_id, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) AS s FROM s""")
def silhouette(spark, d):
    return pinned(nn.silhouette(vectors(spark, d), "vec_id", "v", "label"))


MEANS = f"(SELECT cell, list(x ORDER BY p) AS centre FROM (SELECT label AS cell, p, avg(v[p]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS p FROM {E}) GROUP BY ALL) GROUP BY cell)"
ASSIGNED = f"(SELECT vec_id, v, arg_min(cell, (d2, cell)) AS cell, min(d2) AS d2 FROM (SELECT vec_id, v, cell, list_sum(list_transform(list_zip(v, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM {E}, {MEANS}) GROUP BY vec_id, v)"


@query(f"SELECT vec_id, cell, round(d2, 6) AS cell_d2 FROM {ASSIGNED}")
def kmeans_assign(spark, d):
    v = vectors(spark, d)
    return pinned(nn.assign_cells(v, "v", nn.label_means(v, "v", "label"), "cell", "centre").select("vec_id", "cell", "cell_d2"))


@query(f"SELECT cell, p::INT - 1 AS p, round(avg(v[p]), 6) AS x FROM (SELECT cell, v, unnest(range(1, 65)) AS p FROM {ASSIGNED}) GROUP BY ALL")
def kmeans_one_step(spark, d):
    v = vectors(spark, d)
    return pinned(cl.kmeans_step(v, "v", nn.label_means(v, "v", "label")).select("cell", F.posexplode("centre").alias("p", "x")))


@query()
def kmeans_fit(spark, d):
    centres, inertia = cl.kmeans(vectors(spark, d), "vec_id", "v", 10, rounds=8)
    return centres.select("cell", F.lit(inertia).alias("inertia"), F.col("centre")[0].alias("x0"))


@query(f"WITH c AS (SELECT q.vec_id, q.label, sum(list_distance(q.v, i.v)) AS cost FROM {E} q JOIN {E} i ON q.label = i.label GROUP BY ALL) SELECT label, arg_min(vec_id, (cost, vec_id)) AS medoid, round(min(cost), 6) AS cost FROM c GROUP BY label")
def kmedoid_cost(spark, d):
    return pinned(cl.medoids(cl.medoid_costs(vectors(spark, d), "vec_id", "v", "label"), "vec_id", "label"))


@query(f"SELECT q.vec_id, count(*) AS neighbours, count(*) >= 4 AS core FROM {E} q, {E} i WHERE list_distance(q.v, i.v) <= 0.9 GROUP BY 1")
def dbscan_core_points(spark, d):
    return cl.core_points(vectors(spark, d), "vec_id", "v", 0.9, 4)[0]


@query(f"""WITH RECURSIVE n AS (SELECT q.vec_id AS q, i.vec_id AS i FROM {E} q, {E} i WHERE list_distance(q.v, i.v) <= 0.9), c AS (SELECT q AS k FROM n GROUP BY q HAVING count(*) >= 4),
e AS (SELECT q, i FROM n WHERE q IN (SELECT k FROM c) AND i IN (SELECT k FROM c)), r AS (SELECT k AS v, k AS root FROM c UNION SELECT e.q, r.root FROM r JOIN e ON e.i = r.v), f AS (SELECT v, min(root) AS comp FROM r GROUP BY v)
SELECT vec_id, min(comp) AS cluster FROM embeddings LEFT JOIN n ON n.q = vec_id LEFT JOIN f ON f.v = n.i GROUP BY vec_id""")
def dbscan_clusters(spark, d):
    return cl.dbscan(vectors(spark, d), "vec_id", "v", 0.9, 4)


@query(f"SELECT q AS vec_id, round(d, 6) AS k_distance FROM {ALL_KNN} WHERE rank = 4")
def k_distance(spark, d):
    return pinned(cl.k_distance(vectors(spark, d), "vec_id", "v", 4))


@query(f"""WITH c AS (SELECT * FROM {MEANS}), p AS (SELECT q.vec_id AS q, q.v AS qv, cell FROM {E} q, c WHERE q.{QUERY_ROWS} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, centre) DESC, cell) <= 3),
f AS (SELECT q, a.vec_id AS i FROM p JOIN {ASSIGNED} a USING (cell) WHERE q <> a.vec_id QUALIFY row_number() OVER (PARTITION BY q ORDER BY list_dot_product(qv, a.v) DESC, a.vec_id) <= 10),
x AS (SELECT q.vec_id AS q, i.vec_id AS i FROM {E} q, {E} i WHERE q.{QUERY_ROWS} AND q.vec_id <> i.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, i.v) DESC, i.vec_id) <= 10)
SELECT round(count(f.q) / count(*), 6) AS recall, count(*) AS wanted FROM x LEFT JOIN f USING (q, i)""")
def ivf_probe_recall(spark, d):
    v = vectors(spark, d)
    q = v.where(QUERY_ROWS)
    found = nn.ivf_search(q, v, "vec_id", "v", nn.label_means(v, "v", "label"), probes=3, k=10)
    exact = nn.top_k(nn.met(q, v, "vec_id", "v").select("q", "i", (-fn.dot(F.col("qv"), F.col("iv"))).alias("d")), 10)
    return pinned(nn.recall(found, exact))


@query(f"""WITH m AS (SELECT label, vec_id // 5 AS chunk, p, avg(v[p]) AS x FROM (SELECT *, unnest(range(1, 65)) AS p FROM {E}) GROUP BY ALL), c AS (SELECT label, chunk, list(x ORDER BY p) AS cv FROM m GROUP BY ALL),
q AS (SELECT cell AS label, centre FROM {MEANS}) SELECT label, round(max(list_dot_product(cv, centre) / (sqrt(list_dot_product(cv, cv)) * sqrt(list_dot_product(centre, centre)) + 1e-12)), 6) AS best FROM c JOIN q USING (label) GROUP BY label""")
def chunk_best_cosine(spark, d):
    v = vectors(spark, d)
    flat = v.select("label", F.floor(F.col("vec_id") / 5).alias("chunk"), F.posexplode("v").alias("p", "x")).groupBy("label", "chunk", "p").agg(F.avg("x").alias("x"))
    chunks = flat.groupBy("label", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("cv"))
    centres = nn.label_means(v, "v", "label").withColumnRenamed("cell", "label")
    return pinned(chunks.join(F.broadcast(centres), "label").groupBy("label").agg(F.max(fn.cosine(F.col("cv"), F.col("centre"))).alias("best")))


@query(f"SELECT {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in X4)}, {', '.join(f'round(covar_samp({a}, {b}), 6) AS c_{a}_{b}' for i, a in enumerate(X4) for b in X4[i:])} FROM {FOUR}")
def covariance_matrix(spark, d):
    mean, cov, _ = red.covariance(first_four(spark, d), X4)
    names = [f"mean_{c}" for c in X4] + [f"c_{a}_{b}" for i, a in enumerate(X4) for b in X4[i:]]
    values = [*map(float, mean), *(float(cov[i, j]) for i in range(4) for j in range(i, 4))]
    return spark.createDataFrame([tuple(round(v, 6) + 0.0 for v in values)], ", ".join(f"{n} double" for n in names))


@query()
def pca_projection(spark, d):
    f = first_four(spark, d)
    return pinned(red.reconstruction_error(f, red.pca(f, X4, 2), X4).select("vec_id", "z0", "z1", "residual"))


@query(f"""WITH m AS (SELECT avg(x0) AS a, avg(x1) AS b, var_samp(x0) + 1e-6 AS v, var_samp(x1) + 1e-6 AS w, covar_samp(x0, x1) AS c FROM {FOUR})
SELECT vec_id, round((pow(x0 - a, 2) * w - 2 * (x0 - a) * (x1 - b) * c + pow(x1 - b, 2) * v) / (v * w - c * c), 6) AS mahalanobis_sq FROM {FOUR}, m""")
def mahalanobis(spark, d):
    return pinned(red.mahalanobis_sq(first_four(spark, d), ["x0", "x1"]).select("vec_id", "mahalanobis_sq"))


@query()
def isolation_forest(spark, d):
    return red.isolation_scores(first_four(spark, d), "vec_id", X4, trees=50)


@query()
def gaussian_mixture(spark, d):
    r = cl.mixture(first_four(spark, d), ["x0", "x1"], [[-0.1, 0.0], [0.1, 0.0], [0.0, 0.1]], rounds=10)
    return spark.createDataFrame([(i, float(w), float(m[0]), float(m[1]), float(r["bic"])) for i, (w, m, _) in enumerate(r["model"])], "component int, weight double, x0 double, x1 double, bic double")


ALL_SCORES = f"(SELECT q.vec_id AS q, i.vec_id AS i, list_dot_product(q.v, i.v) / 8 AS s, i.v AS iv FROM {E} q, {E} i)"
SCORES = f"(SELECT q.vec_id AS q, i.vec_id AS i, list_dot_product(q.v, i.v) / 8 AS s, i.v AS iv FROM {E} q, {E} i WHERE q.{QUERY_ROWS})"


@query(f"SELECT q, i, round(exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w), 8) AS weight FROM {SCORES} WINDOW w AS (PARTITION BY q)")
def attention_weights(spark, d):
    v = vectors(spark, d)
    return dense.softmax_weights(v.where(QUERY_ROWS), v, "vec_id", "v", 1 / 8, 8)


@query(f"SELECT q, i, round(exp(s) / sum(exp(s)) OVER (PARTITION BY q), 8) AS weight FROM {ALL_SCORES} WHERE i <= q")
def causal_attention_weights(spark, d):
    v = vectors(spark, d)
    return dense.softmax_weights(v, v, "vec_id", "v", 1 / 8, 8, causal=True)


@query(f"SELECT q, p::INT - 1 AS p, round(sum(exp(s) * iv[p]) / sum(exp(s)), 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS p FROM {ALL_SCORES}) GROUP BY ALL")
def online_softmax_attention(spark, d):
    """Tiles of keys are reduced to (max, sum, weighted sum) and merged: the state of one query is a row a tile, never its scores."""
    v = vectors(spark, d)
    return pinned(dense.softmax_values(dense.softmax_states(v, v, "vec_id", "v", 1 / 8, values=True)))


@query(f"""WITH b AS (SELECT vec_id, list_max(list_transform(v, lambda x: abs(x))) / 7 AS s, v FROM {E}) SELECT vec_id, p::INT - 1 AS p, round(CASE WHEN s > 0 THEN round_even(v[p] / s, 0) * s ELSE 0 END, 6) + 0 AS x FROM (SELECT *, unnest(range(1, 65)) AS p FROM b)""")
def quantize_blockwise(spark, d):
    return pinned(vectors(spark, d).select("vec_id", F.posexplode(fn.quantize_block(F.col("v"), 4)).alias("p", "x")))


@query(f"""WITH m AS (SELECT vec_id, v, list_avg(v) AS mu FROM {E}), s AS (SELECT *, list_avg(list_transform(v, lambda x: (x - mu) * (x - mu))) AS var FROM m)
SELECT vec_id, p::INT - 1 AS p, round((v[p] - mu) / sqrt(var + 1e-5), 5) AS x FROM (SELECT *, unnest(range(1, 65)) AS p FROM s)""")
def layer_norm(spark, d):
    return pinned(vectors(spark, d).select("vec_id", F.posexplode(fn.layer_norm(F.col("v"))).alias("p", "x")), 5)


@query(f"""WITH e AS (SELECT vec_id, v, unnest(range(0, 64)) AS p FROM {E}), a AS (SELECT *, vec_id * pow(10000, -(p - p % 2) / 64) AS t FROM e)
SELECT vec_id, p::INT AS p, round(CASE WHEN p % 2 = 0 THEN v[p + 1] * cos(t) - v[p + 2] * sin(t) ELSE v[p] * sin(t) + v[p + 1] * cos(t) END, 5) AS x FROM a""")
def rope(spark, d):
    return pinned(vectors(spark, d).select("vec_id", F.posexplode(fn.rope(F.col("v"), F.col("vec_id"))).alias("p", "x")), 5)


@query("SELECT i AS position, p::INT AS p, round(CASE WHEN p % 2 = 0 THEN sin(i / pow(10000, (p - p % 2) / 16)) ELSE cos(i / pow(10000, (p - p % 2) / 16)) END, 6) AS x FROM range(64) t(i), range(16) u(p)")
def positional_encoding(spark, d):
    return pinned(spark.range(64).select(F.col("id").alias("position"), F.posexplode(fn.positional_encoding(F.col("id"), 16)).alias("p", "x")))


@query(f"SELECT q.vec_id AS q, i.vec_id AS i, round(list_dot_product(q.v, i.v), 6) AS linear, round(pow(0.5 * list_dot_product(q.v, i.v) + 1, 3), 6) AS poly, round(exp(-0.5 * list_sum(list_transform(list_zip(q.v, i.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS rbf, round(exp(-0.5 * list_sum(list_transform(list_zip(q.v, i.v), lambda z: abs(z[1] - z[2])))), 6) AS laplacian, round(tanh(0.5 * list_dot_product(q.v, i.v) + 1), 6) AS sigmoid FROM {E} q, {E} i WHERE q.{QUERY_ROWS}")
def kernel_matrix(spark, d):
    v = vectors(spark, d)
    return dense.pair_scores(v.where(QUERY_ROWS), v, "vec_id", "v", dense.kernels, ["linear", "poly", "rbf", "laplacian", "sigmoid"], 6, same=True)
