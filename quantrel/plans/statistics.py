"""Queries of statistics, information, numerics and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantrel import functions as fn
from quantrel.operators import information as info
from quantrel.operators import splits
from quantrel.operators import statistics as st
from quantrel.operators.metrics import pinned
from quantrel.sources import table

from .foundations import poisson, uniform
from . import unrolled
from .registry import query


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice), 2) AS var_mle, round(var_samp(l_extendedprice), 2) AS var_unbiased FROM lineitem GROUP BY 1")
def moments_by_group(spark, d):
    r = st.moments(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return r.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("var_mle", 2).alias("var_mle"), F.round("var_unbiased", 2).alias("var_unbiased"))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - 1.959963984540054 * sqrt(var_samp(o_totalprice) / count(*)), 4) AS low,
 round(avg(o_totalprice) + 1.959963984540054 * sqrt(var_samp(o_totalprice) / count(*)), 4) AS high FROM orders GROUP BY 1""")
def z_interval_by_group(spark, d):
    return pinned(st.z_interval(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"), 4)


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), q AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c)
SELECT o_orderpriority, n, k, round(p, 6) AS p, round(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 0), 6) AS wilson_low,
 round(least((p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 1), 6) AS wilson_high, round(p - z*sqrt(p*(1-p)/n), 6) AS wald_low, round(p + z*sqrt(p*(1-p)/n), 6) AS wald_high FROM q""")
def proportion_intervals(spark, d):
    return pinned(st.proportion_intervals(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderpriority"))


@query("""WITH s AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n_a, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mean_a, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS var_a,
 count(*) FILTER (o_orderstatus = 'O') AS n_b, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mean_b, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS var_b FROM orders)
SELECT n_a, round(mean_a, 4) AS mean_a, round(var_a, 4) AS var_a, n_b, round(mean_b, 4) AS mean_b, round(var_b, 4) AS var_b,
 round((mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 4) AS student_t, (n_a + n_b - 2)::DOUBLE AS student_df,
 round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 4) AS welch_t, round(pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)), 4) AS welch_df FROM s""")
def t_tests(spark, d):
    return pinned(st.t_tests(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O"), 4)


@query("""WITH c AS (SELECT (l_quantity > 25) = (l_returnflag = 'R') AS a, (l_discount > 0.05) = (l_returnflag = 'R') AS b FROM lineitem), n AS (SELECT count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (a AND NOT b) AS n10 FROM c)
SELECT n01, n10, round(coalesce(pow(greatest(abs(n01 - n10) - 1, 0), 2) / nullif(n01 + n10, 0), 0), 6) AS chi2 FROM n""")
def mcnemar(spark, d):
    r = F.col("l_returnflag") == "R"
    return pinned(st.mcnemar(table(spark, d, "lineitem"), (F.col("l_quantity") > 25) == r, (F.col("l_discount") > 0.05) == r))


P_VALUES = [(i + 1, p) for i, p in enumerate((0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.0095, 0.5))]


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}::BIGINT, {p}::DOUBLE)" for i, p in P_VALUES)}) t(id, p)), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS k FROM v),
o AS (SELECT *, p <= 0.05::DOUBLE / (m - k + 1) AS h, p <= 0.05::DOUBLE * k / m AS b FROM r)
SELECT id, p, p <= 0.05::DOUBLE / m AS bonferroni, bool_and(h) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS holm, bool_or(b) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS benjamini_hochberg FROM o""")
def multiple_testing(spark, d):
    return st.corrections(spark.createDataFrame(P_VALUES, "id long, p double"), "p", "id")


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice AS v, o_orderstatus = 'F' AS a FROM orders WHERE o_orderstatus IN ('F', 'O')), s AS (SELECT avg(v) FILTER (a) - avg(v) FILTER (NOT a) AS gap, count(*) FILTER (a) AS na FROM o),
r AS (SELECT round, v, row_number() OVER (PARTITION BY round ORDER BY {uniform('0', 'round', 'o_orderkey')}) AS k FROM o, range(1, 201) t(round)), g AS (SELECT round, abs(avg(v) FILTER (k <= na) - avg(v) FILTER (k > na)) AS g FROM r, s GROUP BY round)
SELECT (count(*) FILTER (g >= abs(gap)) + 1) / 201 AS p, round(any_value(gap), 4) AS observed FROM g, s""")
def permutation_p(spark, d):
    return st.permutation_test(table(spark, d, "orders").where("o_orderstatus in ('F', 'O')"), "o_totalprice", F.col("o_orderstatus") == "F", "o_orderkey", rounds=200).withColumn("observed", F.round("observed", 4))


@query(f"""WITH u AS (SELECT round, o_totalprice AS v, {uniform('0', 'round', 'o_orderkey')} AS u FROM orders, range(1, 201) t(round)), m AS (SELECT round, sum(w * v) / sum(w) AS m FROM (SELECT *, {poisson('u')} AS w FROM u) GROUP BY round)
SELECT round(avg(m), 3) AS mean, round(stddev_samp(m), 3) AS se, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m""")
def bootstrap_mean(spark, d):
    return pinned(st.bootstrap_mean(table(spark, d, "orders"), "o_totalprice", "o_orderkey", rounds=200), 3)


@query("WITH c AS (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM c, (SELECT sum(n) AS t FROM c)")
def class_entropy(spark, d):
    return pinned(info.entropy(table(spark, d, "events"), "event_type"))


@query("""WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), j AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)
SELECT round(-sum(n/t * ln(n/t)), 6) AS joint_entropy, round(-sum(n/t * ln(n/nx)), 6) AS conditional_entropy, round(sum(n/t * ln(n*t/(nx*ny))), 6) + 0 AS mutual_information, round(sum(n/t * log2(n*t/(nx*ny))), 6) + 0 AS information_gain FROM j""")
def mutual_information(spark, d):
    return pinned(info.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query("""WITH c AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (o_orderstatus <> 'F')::DOUBLE AS b FROM orders GROUP BY 1), q AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sum(p * ln(p / q)), 8) AS kl, round(sum(-p * ln(q)), 8) AS cross_entropy, round(sum((p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2), 8) AS js FROM q""")
def divergences(spark, d):
    return pinned(info.divergences(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F"), 8)


@query("WITH c AS (SELECT lang, count(*)::DOUBLE AS n FROM documents GROUP BY 1), l AS (SELECT ln(n / sum(n) OVER ()) AS lp, n FROM c) SELECT round(exp(-sum(n * lp) / sum(n)), 6) AS perplexity FROM l")
def perplexity(spark, d):
    langs = table(spark, d, "documents").groupBy("lang").count().withColumn("lp", F.ln(F.col("count") / F.sum("count").over(Window.partitionBy())))
    return pinned(langs.agg(F.exp(-F.sum(F.col("count") * F.col("lp")) / F.sum("count")).alias("perplexity")))


@query(unrolled.HUFFMAN)
def huffman_lengths(spark, d):
    return info.huffman_lengths(table(spark, d, "events"), "event_type")


@query("SELECT l_returnflag, round(avg(l_quantity * l_quantity) - pow(avg(l_quantity), 2), 6) AS naive, round(var_pop(l_quantity), 6) AS stable, round(var_pop(l_quantity + 1e9), 3) AS shifted FROM lineitem GROUP BY 1")
def variance_forms(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(q * q) - F.pow(F.avg(q), F.lit(2)), 6).alias("naive"), F.round(F.var_pop(q), 6).alias("stable"), F.round(F.var_pop(q + 1e9), 3).alias("shifted"))


@query("""SELECT event_id, round(1 / (1 + exp(-value / 50)), 6) AS sigmoid, round(ln(1 + exp(value / 50)), 6) AS softplus, round(greatest(value, 0), 6) AS relu, round(CASE WHEN value > 0 THEN value ELSE 0.01 * value END, 6) AS leaky,
 round(CASE WHEN value / 50 > 0 THEN value / 50 ELSE exp(value / 50) - 1 END, 6) AS elu, round(value / 50 / (1 + exp(-value / 50)), 6) AS swish, round(sign(value - 50) * greatest(abs(value - 50) - 10, 0), 6) + 0 AS shrunk, round(1 / cosh(value / 50) / cosh(value / 50), 6) AS d_tanh FROM events""")
def activations(spark, d):
    v = F.col("value")
    z = v / 50
    return pinned(table(spark, d, "events").select("event_id", fn.sigmoid(z).alias("sigmoid"), fn.softplus(z).alias("softplus"), fn.relu(v).alias("relu"), fn.leaky_relu(v).alias("leaky"), fn.elu(z).alias("elu"), fn.swish(z).alias("swish"), fn.soft_threshold(v - 50, 10.0).alias("shrunk"), fn.d_tanh(z).alias("d_tanh")))


@query("""SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce, round(avg(-(CASE WHEN y = 1 THEN ln(1 / (1 + exp(-z))) ELSE ln(1 - 1 / (1 + exp(-z))) END)), 6) AS naive,
 round(avg(-pow(1 - pt, 2) * ln(pt)), 6) AS focal FROM (SELECT *, CASE WHEN y = 1 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END AS pt FROM (SELECT (l_quantity - 25) / 10 AS z, (l_returnflag = 'R')::INT AS y FROM lineitem))""")
def stable_losses(spark, d):
    rows = table(spark, d, "lineitem").select(((F.col("l_quantity") - 25) / 10).alias("z"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    z, y, p = F.col("z"), F.col("y"), fn.sigmoid(F.col("z"))
    return pinned(rows.agg(F.avg(fn.bce_with_logits(z, y)).alias("bce"), F.avg(-F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("naive"), F.avg(fn.focal(p, y)).alias("focal")))


@query("""WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) SELECT event_id, round(exp((value - top) / 10) / sum(exp((value - top) / 10)) OVER (PARTITION BY user_id), 6) AS share,
 round(top / 10 + ln(sum(exp((value - top) / 10)) OVER (PARTITION BY user_id)), 6) AS logsumexp FROM m""")
def softmax_by_user(spark, d):
    own, v = Window.partitionBy("user_id"), F.col("value") / 10
    top = F.max(v).over(own)
    mass = F.sum(F.exp(v - F.col("top"))).over(own)
    rows = table(spark, d, "events").withColumn("top", top)
    return pinned(rows.select("event_id", (F.exp(v - F.col("top")) / mass).alias("share"), (F.col("top") + F.ln(mass)).alias("logsumexp")))


@query("""SELECT event_id, round(exp(-0.5 * pow((value - 50) / 20, 2)) / (20 * sqrt(2 * pi())), 8) AS gaussian, round(exp(-abs(value - 50) / 20) / 40, 8) AS laplace, round(0.05 * exp(-0.05 * value), 8) AS exponential,
 round(CASE WHEN value < 50 THEN 0.5 * exp((value - 50) / 20) ELSE 1 - 0.5 * exp((50 - value) / 20) END, 8) AS laplace_cdf, round(greatest(least(value / 100, 1), 0), 8) AS uniform_cdf FROM events""")
def densities(spark, d):
    v = F.col("value")
    return pinned(table(spark, d, "events").select("event_id", F.exp(fn.gaussian_logpdf(v, 50.0, 20.0)).alias("gaussian"), fn.laplace_pdf(v, 50.0, 20.0).alias("laplace"), fn.exponential_pdf(v, 0.05).alias("exponential"), fn.laplace_cdf(v, 50.0, 20.0).alias("laplace_cdf"), fn.uniform_cdf(v, 0.0, 100.0).alias("uniform_cdf")), 8)


@query("""WITH c AS (SELECT o_orderpriority AS h, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k FROM orders GROUP BY 1), p AS (SELECT h, n / sum(n) OVER () AS prior, k / n AS likelihood, 1 + k AS a, 1 + n - k AS b FROM c)
SELECT h, round(prior, 6) AS prior, round(prior * likelihood / sum(prior * likelihood) OVER (), 6) AS posterior, round(a / (a + b), 6) AS beta_mean FROM p""")
def bayes_update(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    every = Window.partitionBy()
    prior, like = F.col("n") / F.sum("n").over(every), F.col("k") / F.col("n")
    c = c.select("h", prior.alias("prior"), like.alias("likelihood"), (1 + F.col("k")).alias("a"), (1 + F.col("n") - F.col("k")).alias("b"))
    both = F.col("prior") * F.col("likelihood")
    return pinned(c.select("h", "prior", (both / F.sum(both).over(every)).alias("posterior"), (F.col("a") / (F.col("a") + F.col("b"))).alias("beta_mean")))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) SELECT o_orderpriority AS cat, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS target_mean FROM orders GROUP BY 1""")
def naive_target_mean(spark, d):
    return pinned(table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cat")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("target_mean")))


@query("""SELECT o_orderkey, round((coalesce(sum((o_orderstatus = 'F')::INT) OVER w, 0) + 0.5) / (count(*) OVER w + 1), 6) AS ordered_mean FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ordered_target_stats(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    y = (F.col("o_orderstatus") == "F").cast("int")
    return pinned(table(spark, d, "orders").select("o_orderkey", ((F.coalesce(F.sum(y).over(w), F.lit(0)) + 0.5) / (F.count(F.lit(1)).over(w) + 1)).alias("ordered_mean")))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 5)::BIGINT AS fold FROM orders")
def kfold_ids(spark, d):
    return splits.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5)::BIGINT AS fold FROM labels")
def stratified_fold_ids(spark, d):
    return splits.stratified(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS rn, count(*) OVER () // 5 AS size FROM events), s AS (SELECT unnest(range(1, 5)) AS split)
SELECT split::INT AS split, count(*) FILTER (rn <= split * size) AS train, count(*) FILTER (rn > split * size AND rn <= (split + 1) * size) AS test FROM r, s GROUP BY 1""")
def timeseries_split(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return splits.forward_chaining(e, "t", ("event_id",), 4)
