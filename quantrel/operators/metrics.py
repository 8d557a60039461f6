"""Regression, classification and ranking metrics as single aggregates or ordered totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantrel import functions as fn

from .ordered import running_totals


def regression_metrics(df: DataFrame, y: str, p: str, delta: float = 1.0, tau: float = 0.5, predictors: int = 1) -> DataFrame:
    """One row: mse, rmse, mae, r2, adjusted_r2, mape, smape, rmsle, huber, pinball; ratios skip rows with a zero denominator."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    r = yy - pp
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"), F.var_pop(yy).alias("v"),
        (100 * F.avg(F.abs(fn.ratio(r, yy)))).alias("mape"), (100 * F.avg(fn.ratio(F.abs(r), (F.abs(yy) + F.abs(pp)) / 2))).alias("smape"),
        F.sqrt(F.avg(F.pow(F.log1p(yy) - F.log1p(pp), F.lit(2)))).alias("rmsle"), F.avg(fn.huber(r, delta)).alias("huber"), F.avg(fn.pinball(r, tau)).alias("pinball"),
    )
    r2 = 1 - fn.ratio(F.col("mse"), F.col("v"))
    adjusted = 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - predictors - 1)
    return sums.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), adjusted.alias("adjusted_r2"), "mape", "smape", "rmsle", "huber", "pinball")


def confusion(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn for labels 0 and 1."""
    a, b = F.col(y), F.col(p)
    counts = [F.count_if((a == i) & (b == j)).alias(k) for k, i, j in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]
    return df.groupBy(*by).agg(*counts)


def from_confusion(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """accuracy, precision, recall, specificity, fbeta, mcc, kappa; 0 where a denominator is 0."""
    tp, fp, tn, fneg = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fneg
    precision, recall = fn.ratio(tp, tp + fp, 0.0), fn.ratio(tp, tp + fneg, 0.0)
    b2 = beta * beta
    chance = ((tp + fp) * (tp + fneg) + (tn + fp) * (tn + fneg)) / (n * n)
    accuracy = fn.ratio(tp + tn, n, 0.0)
    mcc = fn.ratio(tp * tn - fp * fneg, F.sqrt((tp + fp) * (tp + fneg) * (tn + fp) * (tn + fneg)), 0.0)
    return df.select(
        "*", accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), fn.ratio(tn, tn + fp, 0.0).alias("specificity"),
        fn.ratio((1 + b2) * precision * recall, b2 * precision + recall, 0.0).alias("fbeta"), mcc.alias("mcc"), fn.ratio(accuracy - chance, 1 - chance, 0.0).alias("kappa"),
    )


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """A row for each distinct score with its positives and negatives: ties meet here, before any order is needed."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """score, fpr, tpr with ties merged, without the origin."""
    counts = score_counts(df, y, score)
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return running_totals(counts, "score", {"tp": "pos", "fp": "neg"}, descending=True).join(F.broadcast(total)).select("score", fn.ratio(F.col("fp"), F.col("all_neg")).alias("fpr"), fn.ratio(F.col("tp"), F.col("all_pos")).alias("tpr"), "pos", "neg", "tp", "fp")


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Share of positive and negative pairs in the right order, ties half: one order, no pair join."""
    rows = running_totals(score_counts(df, y, score), "score", {"below": "neg"})
    wins = F.sum(F.col("pos").cast("double") * (F.col("below") - 0.5 * F.col("neg")))
    return rows.agg(fn.ratio(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def average_precision(df: DataFrame, y: str, score: str, ties: tuple[str, ...]) -> DataFrame:
    """Precision at each positive row, averaged; rows of equal score come in the order of `ties`."""
    rows = running_totals(df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y"), *ties), "score", {"tp": "y", "seen": "1"}, descending=True, ties=ties)
    return rows.where("y = 1").agg(F.avg(F.col("tp") / F.col("seen")).alias("average_precision"))


def average_precision_merged(df: DataFrame, y: str, score: str) -> DataFrame:
    """The same over distinct scores: ties count at once."""
    rows = running_totals(score_counts(df, y, score), "score", {"tp": "pos", "seen": "pos + neg"}, descending=True)
    return rows.agg(fn.ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = fn.clip(F.col(p).cast("double"), eps, 1 - eps)
    yy = F.col(y).cast("double")
    return df.agg(F.avg(-(yy * F.ln(q) + (1 - yy) * F.ln(1 - q))).alias("log_loss"), F.avg(F.pow(F.col(p) - yy, F.lit(2))).alias("brier"))


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: list[float], cost_fp: float = 1.0, cost_fn: float = 1.0) -> DataFrame:
    """Confusion and cost at each threshold (flag if score >= t), all in one aggregate over the rows."""
    s, a = F.col(score), F.col(y)
    cells = [F.struct(F.lit(float(t)).alias("threshold"), *(F.count_if((a == i) & ((s >= t) == bool(j))).alias(k) for k, i, j in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0)))) for t in thresholds]
    flat = df.agg(*(c.alias(f"t{i}") for i, c in enumerate(cells)))
    rows = flat.select(F.inline(F.array(*(f"t{i}" for i in range(len(cells))))))
    return rows.withColumn("cost", cost_fp * F.col("fp") + cost_fn * F.col("fn"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.min(F.struct("cost", "threshold")).alias("b")).select("b.threshold", "b.cost")


def micro_macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class tp, fp, fn by one pass over (truth, predicted) counts; macro averages F1, micro sums counts."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).count()
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("t") != F.col("p"), F.col("count")).otherwise(0).alias("fn")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.when(F.col("t") != F.col("p"), F.col("count")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    by = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = lambda tp, fp, fneg: fn.ratio(2 * tp, 2 * tp + fp + fneg, 0.0)
    return by.agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), F.count("c").alias("classes"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy over equal-width bins [low, high), the last closed; empty bins are absent."""
    q = F.col(p).cast("double")
    edges = [i / bins for i in range(1, bins)]
    bin_ = sum(((q >= e).cast("int") for e in edges), F.lit(0))
    return df.where((q >= 0) & (q <= 1)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier_decomposition(bins: DataFrame) -> DataFrame:
    """reliability, resolution and uncertainty from the bin table alone."""
    total = bins.agg(F.sum("n").alias("all_rows"), (F.sum(bins["n"] * bins["accuracy"]) / F.sum(bins["n"])).alias("base"))
    both = bins.join(F.broadcast(total))
    share = F.col("n") / F.col("all_rows")
    return both.agg(
        F.sum(share * F.pow(F.col("confidence") - F.col("accuracy"), F.lit(2))).alias("reliability"), F.sum(share * F.pow(F.col("accuracy") - F.col("base"), F.lit(2))).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def pinned(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and without a negative zero, so that results compare by value."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def previous(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
