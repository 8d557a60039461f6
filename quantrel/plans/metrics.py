"""Queries of metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantrel.operators import metrics as m
from quantrel.sources import table

from .registry import query

SCORED = "(SELECT (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, l_extendedprice AS s, l_discount * 10 AS p FROM lineitem)"


def scored(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("s"), (F.col("l_discount") * 10).alias("p"))


@query(f"""WITH c AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {SCORED} GROUP BY s),
r AS (SELECT *, sum(neg) OVER (ORDER BY s) AS below FROM c)
SELECT round(sum(pos::DOUBLE * (below - 0.5 * neg)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM r""")
def roc_auc(spark, d):
    return m.pinned(m.roc_auc(scored(spark, d), "y", "s"))


@query(f"""WITH c AS (SELECT p AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {SCORED} GROUP BY p)
SELECT round(score, 6) AS score, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, pos, neg, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp
FROM c WINDOW w AS (ORDER BY score DESC)""")
def roc_points(spark, d):
    return m.pinned(m.roc_points(scored(spark, d), "y", "p"))


@query("""WITH r AS (SELECT y, sum(y) OVER w AS tp, count(*) OVER w AS seen FROM (SELECT (o_orderstatus = 'F')::INT AS y, o_totalprice AS s, o_orderkey AS k FROM orders) WINDOW w AS (ORDER BY s DESC, k ROWS UNBOUNDED PRECEDING))
SELECT round(avg(tp / seen), 6) AS average_precision FROM r WHERE y = 1""")
def average_precision(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("s"), "o_orderkey")
    return m.pinned(m.average_precision(o, "y", "s", ("o_orderkey",)))


@query(f"""WITH c AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM {SCORED} GROUP BY p), r AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM r""")
def average_precision_tied(spark, d):
    return m.pinned(m.average_precision_merged(scored(spark, d), "y", "p"))


@query(f"""WITH q AS (SELECT y, p, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM {SCORED})
SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM q""")
def log_loss_brier(spark, d):
    return m.pinned(m.log_loss(scored(spark, d), "y", "p"))


REGRESSION = """WITH j AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v, 100 * avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) AS mape,
 100 * avg(CASE WHEN abs(y) + abs(p) <> 0 THEN abs(y - p) / ((abs(y) + abs(p)) / 2) END) AS smape, sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))) AS rmsle,
 avg(CASE WHEN abs(y - p) <= 100 THEN 0.5 * (y - p) * (y - p) ELSE 100 * (abs(y - p) - 50) END) AS huber, avg(greatest(0.9 * (y - p), -0.1 * (y - p))) AS pinball FROM j)
SELECT n, round(mse, 3) AS mse, round(sqrt(mse), 3) AS rmse, round(mae, 3) AS mae, round(1 - mse / v, 3) AS r2, round(1 - (mse / v) * (n - 1) / (n - 2), 3) AS adjusted_r2, round(mape, 3) AS mape,
 round(smape, 3) AS smape, round(rmsle, 3) AS rmsle, round(huber, 3) AS huber, round(pinball, 3) AS pinball FROM e"""


@query(REGRESSION)
def regression_metrics(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    return m.pinned(m.regression_metrics(j, "y", "p", delta=100.0, tau=0.9), 3)


FLAGGED = "(SELECT quality AS y, (CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) AS p, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id))"


def flagged(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") >= 1000).cast("int").alias("p"), F.col("n_chars").cast("double").alias("s"))


@query(f"""WITH c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM {FLAGGED}),
r AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS pr, tp::DOUBLE / nullif(tp + fn, 0) AS rc, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS ac,
 ((tp + fp)::DOUBLE * (tp + fn) + (tn + fp)::DOUBLE * (tn + fn)) / ((tp + fp + tn + fn)::DOUBLE * (tp + fp + tn + fn)) AS ch FROM c)
SELECT tp, fp, tn, fn, round(ac, 6) AS accuracy, round(coalesce(pr, 0), 6) AS precision, round(coalesce(rc, 0), 6) AS recall, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS specificity,
 round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS fbeta, round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
 round(coalesce((ac - ch) / nullif(1 - ch, 0), 0), 6) AS kappa FROM r""")
def confusion_metrics(spark, d):
    return m.pinned(m.from_confusion(m.confusion(flagged(spark, d), "y", "p")))


SWEEP = f"""SELECT t AS threshold, count(*) FILTER (y = 1 AND s >= t) AS tp, count(*) FILTER (y = 0 AND s >= t) AS fp, count(*) FILTER (y = 0 AND s < t) AS tn, count(*) FILTER (y = 1 AND s < t) AS fn,
 (5.0 * count(*) FILTER (y = 0 AND s >= t) + count(*) FILTER (y = 1 AND s < t))::DOUBLE AS cost FROM {FLAGGED}, (SELECT unnest([100, 300, 1000, 3000, 10000])::DOUBLE AS t) GROUP BY t"""


def sweep(spark, d):
    return m.threshold_sweep(flagged(spark, d), "y", "s", [100, 300, 1000, 3000, 10000], cost_fp=5.0)


@query(SWEEP)
def threshold_sweep(spark, d):
    return sweep(spark, d)


@query(f"SELECT threshold, cost FROM ({SWEEP}) ORDER BY cost, threshold LIMIT 1")
def cost_threshold(spark, d):
    return m.best_threshold(sweep(spark, d))


@query("""WITH e AS (SELECT event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), x AS (SELECT * FROM e WHERE p IS NOT NULL),
c AS (SELECT c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t <> c AND p = c) AS fp, count(*) FILTER (t = c AND p <> c) AS fn FROM x, (SELECT t AS c FROM x UNION SELECT p FROM x) GROUP BY c)
SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS classes FROM c""")
def micro_macro_f1(spark, d):
    e = m.previous(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "before").where("before is not null")
    return m.pinned(m.micro_macro_f1(e, "event_type", "before"))


BINS = f"""(WITH q AS (SELECT y, p, (p >= 0.1::DOUBLE)::INT + (p >= 0.2::DOUBLE)::INT + (p >= 0.3::DOUBLE)::INT + (p >= 0.4::DOUBLE)::INT + (p >= 0.5::DOUBLE)::INT + (p >= 0.6::DOUBLE)::INT + (p >= 0.7::DOUBLE)::INT + (p >= 0.8::DOUBLE)::INT + (p >= 0.9::DOUBLE)::INT AS bin FROM {SCORED} WHERE p BETWEEN 0 AND 1)
SELECT bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM q GROUP BY bin)"""


def bins(spark, d):
    return m.reliability(scored(spark, d), "y", "p")


@query(f"SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM {BINS}")
def reliability_bins(spark, d):
    return m.pinned(bins(spark, d))


@query(f"SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS mce FROM {BINS}")
def calibration_errors(spark, d):
    return m.pinned(m.calibration_errors(bins(spark, d)))


@query(f"""WITH b AS (SELECT * FROM {BINS}), t AS (SELECT sum(n) AS nn, sum(n * accuracy) / sum(n) AS base FROM b)
SELECT round(sum(n / nn * pow(confidence - accuracy, 2)), 6) AS reliability, round(sum(n / nn * pow(accuracy - base, 2)), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM b, t""")
def brier_decomposition(spark, d):
    return m.pinned(m.brier_decomposition(bins(spark, d)))
