"""Queries of relational odds and ends, sampling, estimation and ensembles over any estimator."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantrel import functions as fn
from quantrel.operators import ensembles as en
from quantrel.operators import ordered
from quantrel.operators import statistics as st
from quantrel.operators import trees
from quantrel.operators.metrics import pinned
from quantrel.sources import table

from .registry import query


def uniform(*keys: str) -> str:
    """SQL of functions.hashed_uniform."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def poisson(u: str) -> str:
    """SQL of a Poisson(1) count by inversion, cut off at 8."""
    return "(" + " + ".join(f"({u} >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE)::INT" for k in range(8)) + ")"


def normal(u1: str, u2: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2}))"


RATES = "CASE WHEN l_tax > 0 THEN l_discount / l_tax WHEN l_discount > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END"


@query(f"""SELECT l_returnflag, count(*) AS n, count(*) FILTER (isfinite(r)) AS n_finite, count(*) FILTER (isinf(r)) AS n_infinite, count(*) FILTER (isnan(r)) AS n_nan, round(avg(r) FILTER (isfinite(r)), 6) AS mean
FROM (SELECT l_returnflag, {RATES} AS r FROM lineitem) GROUP BY 1""")
def finite_rates(spark, d):
    r = F.when(F.col("l_tax") > 0, fn.ratio(F.col("l_discount"), F.col("l_tax"))).when(F.col("l_discount") > 0, float("inf")).otherwise(float("nan"))
    t, x = table(spark, d, "lineitem").select("l_returnflag", r.alias("r")), F.col("r")
    return pinned(t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(fn.is_finite(x)).alias("n_finite"), F.count_if(F.abs(x) == float("inf")).alias("n_infinite"), F.count_if(F.isnan(x)).alias("n_nan"), F.avg(F.when(fn.is_finite(x), x)).alias("mean")))


@query(f"""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), s AS (SELECT b, i FROM r, range(5) t(b)),
drawn AS (SELECT DISTINCT b, floor({uniform("'oob'", 'b', 'i')} * n)::BIGINT AS i FROM s, n)
SELECT b, count(*) AS n_out, round(avg(v), 4) AS mean_out FROM (SELECT s.b, r.v FROM s JOIN r USING (i) ANTI JOIN drawn USING (b, i)) GROUP BY b""")
def out_of_bag_rows(spark, d):
    rows = ordered.numbered(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), "o_orderkey", "i").select((F.col("i") - 1).alias("i"), "v")
    n = rows.count()
    slots = rows.select("i", "v", F.explode(F.array(*(F.lit(b).cast("long") for b in range(5)))).alias("b"))
    drawn = slots.select("b", F.floor(fn.hashed_uniform(F.lit("oob"), F.col("b"), F.col("i")) * n).cast("long").alias("i")).distinct()
    return pinned(slots.join(drawn, ["b", "i"], "left_anti").groupBy("b").agg(F.count(F.lit(1)).alias("n_out"), F.avg("v").alias("mean_out")), 4)


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def medians_by_group(spark, d):
    return pinned(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("median"), F.percentile("o_totalprice", F.lit(0.9)).alias("p90")), 4)


@query("SELECT least(floor((l_quantity - 0) / 5), 9)::BIGINT AS bx, least(floor(l_discount / 0.025), 3)::BIGINT AS \"by\", count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY ALL")
def histogram_2d(spark, d):
    return st.histogram_2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", (0.0, 50.0, 10), (0.0, 0.1, 4))


@query("SELECT o_orderkey, round(min(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS best FROM orders")
def running_minimum(spark, d):
    return pinned(ordered.running_minimum(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", "best").select("o_orderkey", "best"), 4)


@query("""WITH e AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM lineitem GROUP BY 1),
b AS (SELECT l.l_returnflag, l_extendedprice AS v, len(list_filter(e, lambda x: x <= l_extendedprice)) AS bin FROM lineitem l JOIN e USING (l_returnflag)) SELECT l_returnflag, bin, count(*) AS n, round(min(v), 4) AS low, round(max(v), 4) AS high FROM b GROUP BY ALL""")
def quantile_bins(spark, d):
    b = st.quantile_bins(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", 8, "l_returnflag")
    return pinned(b.groupBy("l_returnflag", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")), 4)


@query("""WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, len(a)), lambda i: a[i:i + 1])) AS x, list_distinct(list_transform(range(1, len(b)), lambda i: b[i:i + 1])) AS y FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part))
SELECT p_partkey, len(list_filter(x, lambda v: NOT list_contains(y, v))) + len(list_filter(y, lambda v: NOT list_contains(x, v))) AS n, array_to_string(list_sort(list_concat(list_filter(x, lambda v: NOT list_contains(y, v)), list_filter(y, lambda v: NOT list_contains(x, v)))), '|') AS grams FROM g""")
def symmetric_difference(spark, d):
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.lower(c), i, F.lit(2))))
    t = table(spark, d, "part").select("p_partkey", grams(F.col("p_name")).alias("x"), grams(F.col("p_type")).alias("y"))
    both = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    return t.select("p_partkey", F.size(both).cast("long").alias("n"), F.array_join(F.array_sort(both), "|").alias("grams"))


@query("""WITH o AS (SELECT user_id, event_id, sqrt(abs(value)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT a.event_id, round(sum(0.1 * b.v * pow(0.9, a.p - b.p)), 6) AS average FROM o a JOIN o b ON a.user_id = b.user_id AND b.p BETWEEN a.p - 372 AND a.p GROUP BY a.event_id""")
def exponential_average(spark, d):
    return pinned(ordered.exponential_moving(table(spark, d, "events").withColumn("root", F.sqrt(F.abs("value"))), "user_id", ("ts", "event_id"), "root", 0.9, "average").select("event_id", "average"))


GRID = "range(1, 10) a(i), range(5, 10) b(j), range(5, 10) c(k)"


@query(f"""WITH g AS (SELECT i, j, k, i / 100.0::DOUBLE AS p, j / 10.0::DOUBLE AS se, k / 10.0::DOUBLE AS sp FROM {GRID}) SELECT i, j, k, round(se * p / (se * p + (1 - sp) * (1 - p)), 6) AS posterior, round(se * p + (1 - sp) * (1 - p), 6) AS p_positive,
 round((1 - sp) * (1 - p) / (se * p), 6) AS false_to_true_ratio, round(se / (1 - sp), 6) AS likelihood_ratio, round(p / (1 - p), 6) AS prior_odds FROM g""")
def disease_test_grid(spark, d):
    i, j, k = (spark.range(a, b).withColumnRenamed("id", c) for a, b, c in ((1, 10, "i"), (5, 10, "j"), (5, 10, "k")))
    g = i.crossJoin(j).crossJoin(k)
    return pinned(g.select("i", "j", "k", *st.posterior_of_test(F.col("i") / 100, F.col("j") / 10, F.col("k") / 10)))


@query("""SELECT o_orderpriority, count(*) AS n, round(1 / nullif(avg((o_orderstatus = 'F')::INT) * (1 - avg((o_orderstatus = 'F')::INT)), 0), 6) AS bernoulli, round(1e9 / var_pop(o_totalprice), 6) AS gaussian_mean FROM orders GROUP BY 1""")
def fisher_information(spark, d):
    r = st.fisher_information(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_totalprice", "o_orderpriority")
    return pinned(r.withColumn("gaussian_mean", F.col("gaussian_mean") * 1e9))


DRAWS = f"(SELECT t, i, 3 + 2 * {normal(uniform(chr(39) + 'a' + chr(39), 't', 'i'), uniform(chr(39) + 'b' + chr(39), 't', 'i'))} AS x FROM range(400) a(t), range(10) b(i))"


def draws(spark):
    t = spark.range(400).withColumnRenamed("id", "t").select("t", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    u = lambda s: fn.hashed_uniform(F.lit(s), F.col("t"), F.col("i"))
    return t.withColumn("x", 3 + 2 * fn.box_muller(u("a"), u("b")))


@query(f"""WITH e AS (SELECT t, var_pop(x) AS mle, var_samp(x) AS unbiased, avg(x) + 1 AS mean_plus_one FROM {DRAWS} GROUP BY t), l AS (SELECT * FROM (UNPIVOT e ON mle, unbiased, mean_plus_one INTO NAME estimator VALUE v))
SELECT estimator, round(avg(v) - 4, 6) AS bias, round(var_pop(v), 6) AS variance, round(avg(pow(v - 4, 2)), 6) AS mse FROM l GROUP BY 1""")
def estimator_bias(spark, d):
    return pinned(st.measure_estimators(draws(spark), "t", {"mle": F.var_pop("x"), "unbiased": F.var_samp("x"), "mean_plus_one": F.avg("x") + 1}, 4.0))


@query(f"""WITH s AS (SELECT i, {uniform("'x'", 'i')} AS x, {uniform("'y'", 'i')} AS y FROM range(20000) t(i)) SELECT count(*) AS accepted, round(count(*) / 20000, 6) AS share, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM s WHERE y <= 4 * x * (1 - x)""")
def rejection_sample(spark, d):
    u = lambda s: fn.hashed_uniform(F.lit(s), F.col("id"))
    s = spark.range(20000).select(u("x").alias("x"), u("y").alias("y")).where(F.col("y") <= 4 * F.col("x") * (1 - F.col("x")))
    return pinned(s.agg(F.count(F.lit(1)).alias("accepted"), (F.count(F.lit(1)) / 20000).alias("share"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance")))


@query("""WITH s AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS na, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ma, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus = 'F') AS ea,
 count(*) FILTER (o_orderstatus = 'O') AS nb, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mb, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus = 'O') AS eb FROM orders GROUP BY 1)
SELECT o_orderpriority, round((ma - mb) / sqrt(ea + eb), 6) AS t, round(pow(ea + eb, 2) / (ea * ea / (na - 1) + eb * eb / (nb - 1)), 4) AS df FROM s""")
def welch_by_group(spark, d):
    r = st.welch_by_group(table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", "o_orderpriority")
    return r.select("o_orderpriority", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


NOISY = f"(SELECT s, x, sin(pi() * x) + 0.5 * {normal(uniform(chr(39) + 'p' + chr(39), 's', 'i'), uniform(chr(39) + 'q' + chr(39), 's', 'i'))} AS y FROM (SELECT s, i, 2 * {uniform(chr(39) + 'x' + chr(39), 's', 'i')} - 1 AS x FROM range(200) a(s), range(40) b(i)))"


@query(f"""WITH f AS (SELECT s, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {NOISY} GROUP BY s), p AS (SELECT g / 10 - 1 AS x, a + b * (g / 10 - 1) AS p, sin(pi() * (g / 10 - 1)) AS f FROM f, range(21) t(g))
SELECT round(x, 6) AS x, round(pow(avg(p) - max(f), 2), 6) AS bias2, round(var_pop(p), 6) AS variance, round(pow(avg(p) - max(f), 2) + var_pop(p) + 0.25, 6) AS total FROM p GROUP BY x""")
def bias_variance(spark, d):
    rows = spark.range(200).withColumnRenamed("id", "s").select("s", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    u = lambda n: fn.hashed_uniform(F.lit(n), F.col("s"), F.col("i"))
    rows = rows.withColumn("x", 2 * u("x") - 1).withColumn("y", F.sin(math.pi * F.col("x")) + 0.5 * fn.box_muller(u("p"), u("q")))
    grid = spark.range(21).select((F.col("id") / 10 - 1).alias("x"))
    return pinned(st.bias_variance(rows, "s", "x", "y", grid, F.sin(math.pi * F.col("x")), 0.5))


@query("""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx, var_pop(l_extendedprice) AS vy, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT x::DOUBLE AS x, round(my + c / vx * (x - mx), 3) AS mean, round(vy - c * c / vx, 1) AS variance, round(my, 3) AS marginal_mean, round(vy, 1) AS marginal_variance FROM m, (VALUES (10), (25), (40)) t(x)""")
def gaussian_conditional(spark, d):
    r = st.gaussian_conditional(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", [10.0, 25.0, 40.0])
    return r.select("x", F.round("mean", 3).alias("mean"), F.round("variance", 1).alias("variance"), F.round("marginal_mean", 3).alias("marginal_mean"), F.round("marginal_variance", 1).alias("marginal_variance"))


# --- any estimator


def items(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))


def line():
    return en.Linear(("l_quantity",), "y")


@query("""WITH t AS (SELECT l_orderkey % 5 AS fold, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t, range(5) r(k) WHERE fold <> k GROUP BY k)
SELECT k AS fold, round(1 - avg(pow(y - a - b * x, 2)) / var_pop(y), 6) AS r2 FROM t JOIN m ON fold = k GROUP BY k""")
def cross_validated_r2(spark, d):
    t = items(spark, d).withColumn("fold", F.col("l_orderkey") % 5)
    scores = en.cross_val_score(t, "fold", list(range(5)), line, en.r2_score("y"))
    return spark.createDataFrame([(k, round(s, 6)) for k, s in enumerate(scores)], "fold long, r2 double")


BAGS = f"""t AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), u AS (SELECT t.*, b, {uniform("'bag'", 'b', 'l_orderkey', 'l_linenumber')} AS u FROM t, range(4) r(b)),
w AS (SELECT *, {poisson('u')} AS w FROM u), s AS (SELECT b, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY b),
m AS (SELECT b, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS icpt FROM s)"""


@query(f"""WITH {BAGS}, p AS (SELECT rid, any_value(y) AS y, avg(icpt + slope * x) AS p, avg(icpt + slope * x) FILTER (w = 0) AS o FROM w JOIN m USING (b) GROUP BY ALL)
SELECT count(*) AS n, count(o) AS n_oob, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2, round(1 - avg(pow(y - o, 2)) / var_pop(y) FILTER (o IS NOT NULL), 6) AS r2_oob FROM p""")
def bagged_regression(spark, d):
    t = items(spark, d)
    keys = ("l_orderkey", "l_linenumber")
    p = en.bagged(t, en.bag(t, line, 4, *keys), "p", *keys)
    e = lambda c: F.avg(F.pow(F.col("y") - F.col(c), F.lit(2)))
    held = F.when(F.col("p_oob").isNotNull(), F.col("y"))
    return pinned(p.agg(F.count(F.lit(1)).alias("n"), F.count("p_oob").alias("n_oob"), (1 - e("p") / F.var_pop("y")).alias("r2"), (1 - e("p_oob") / F.var_pop(held)).alias("r2_oob")))


@query(f"""WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice / 1000 AS y, {uniform("'held'", 'l_orderkey')} < 0.2 AS h FROM lineitem), m AS (SELECT regr_slope(y, a) AS ba, regr_intercept(y, a) AS ia, regr_slope(y, b) AS bb, regr_intercept(y, b) AS ib FROM t WHERE NOT h),
p AS (SELECT ia + ba * a AS p, ib + bb * b AS q, y, h FROM t, m), s AS (SELECT avg(p) AS mp, avg(q) AS mq, avg(y) AS my, covar_pop(p, y) AS py, covar_pop(q, y) AS qy, covar_pop(p, q) AS pq, var_pop(p) AS pp, var_pop(q) AS qq FROM p WHERE h),
c AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS wp, (qy * pp - py * pq) / (pp * qq - pq * pq) AS wq FROM s) SELECT round(1 - avg(pow(y - (my + wp * (p - mp) + wq * (q - mq)), 2)) / var_pop(y), 5) AS r2 FROM p, c""")
def blended_regression(spark, d):
    t = items(spark, d)
    predict = en.blend(t, fn.hashed_uniform(F.lit("held"), F.col("l_orderkey")) < 0.2, [line(), en.Linear(("l_discount",), "y")], lambda names: en.Linear(names, "y"))
    return pinned(spark.createDataFrame([(float(en.r2_score("y")(predict(t, "p"), "p")),)], "r2 double"), 5)


# --- boosting of any loss, splits over bins, several classes


@query("""WITH t AS (SELECT l_extendedprice / 1000 AS y FROM lineitem), i AS (SELECT avg(y) AS sq, median(y) AS md, quantile_cont(y, 0.8) AS q FROM t), h AS (SELECT quantile_cont(abs(y - md), 0.9) AS h FROM t, i), r AS (SELECT y - sq AS a, y - md AS b, y - q AS c, sq, md, q, h FROM t, i, h)
SELECT 'squared' AS loss, round(any_value(sq), 5) AS start, round(avg(a * a) / 2, 4) AS value, round(avg(a), 5) AS gradient FROM r UNION ALL SELECT 'absolute', round(any_value(md), 5), round(avg(abs(b)), 4), round(avg(sign(b)), 5) FROM r
UNION ALL SELECT 'huber', round(any_value(md), 5), round(avg(CASE WHEN abs(b) <= h THEN b * b / 2 ELSE h * (abs(b) - h / 2) END), 4), round(avg(greatest(least(b, h), -h)), 5) FROM r
UNION ALL SELECT 'quantile', round(any_value(q), 5), round(avg(CASE WHEN c > 0 THEN 0.8 * c ELSE -0.2 * c END), 4), round(avg(CASE WHEN c > 0 THEN 0.8 ELSE -0.2 END), 5) FROM r""")
def boosting_starts(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"))
    r = trees.loss_starts(t, "y", huber_share=0.9, tau=0.8)
    return r.select("loss", F.round("start", 5).alias("start"), F.round("value", 4).alias("value"), (F.round("gradient", 5) + F.lit(0.0)).alias("gradient"))


@query("""WITH m AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v, l_extendedprice / 1000 - 50 AS g FROM lineitem), e AS (SELECT feature, list_distinct(quantile_cont(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS e FROM m GROUP BY 1),
b AS (SELECT feature, len(list_filter(e, lambda x: x <= v)) AS bin, sum(g) AS g, count(*) AS h FROM m JOIN e USING (feature) GROUP BY ALL), c AS (SELECT feature, bin, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER p AS g, sum(h) OVER p AS h FROM b WINDOW o AS (PARTITION BY feature ORDER BY bin), p AS (PARTITION BY feature))
SELECT feature, bin::INT AS bin, round(0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)), 4) AS gain FROM c WHERE hl >= 20 AND h - hl >= 20""")
def histogram_gains(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000 - 50).alias("g"), F.lit(1.0).alias("h"))
    return pinned(trees.histogram_gains(t, ["l_quantity", "l_discount", "l_tax"], "g", "h", bins=8, lam=1.0, min_child_weight=20.0), 4)


@query("""WITH n AS (SELECT l_quantity <= 25 AS side, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY ALL), v AS (SELECT side, arg_min(c, (-n, c)) AS vote FROM n GROUP BY 1), r AS (SELECT sum(n) AS n, sum(n) FILTER (c <> vote) / sum(n) AS e FROM n JOIN v USING (side)), a AS (SELECT n, e, ln((1 - e) / e) + ln(2) AS alpha FROM r)
SELECT round(e, 8) AS error, round(alpha, 6) AS alpha, round(e * exp(alpha) / (e * exp(alpha) + 1 - e), 6) AS wrong_share FROM a""".replace("(-n, c)", "[-n, ascii(c)]"))
def multiclass_boost_step(spark, d):
    return pinned(trees.samme_step(table(spark, d, "lineitem").withColumn("w", F.lit(1.0)), F.col("l_quantity") <= 25, "l_returnflag", "w", 3), 8).select("error", F.round("alpha", 6).alias("alpha"), F.round("wrong_share", 6).alias("wrong_share"))
