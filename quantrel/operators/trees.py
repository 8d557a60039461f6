"""Split search, trees, boosting: histograms of (node, feature, value) in one aggregate a level; the model is a small node table."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantrel import functions as fn

#: Range buckets that a feature's values are cut into, at most.
MAX_PARTS = 64
#: Distinct values of a feature (estimated in the fit's first pass) up to which its splits are searched as one group.
ONE_GROUP = 100_000


def value_counts(df: DataFrame, features: list[str], stats: dict[str, Column], node: str | None = None) -> DataFrame:
    """(node,) feature, value and summed stats: rows are melted in place and summed before the shuffle."""
    keys = [node] if node else []
    melted = df.select(*keys, *(c.alias(f"__{k}") for k, c in stats.items()), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("x"))
    return melted.groupBy(*keys, F.col("x.feature").alias("feature"), F.col("x.value").alias("value")).agg(*(F.sum(f"__{k}").alias(k) for k in stats))


def split_table(counts: DataFrame, stats: list[str], node: str | None = None, wide: bool = True) -> DataFrame:
    """Each midpoint of neighbouring values with left sums l_* and totals t_*; value <= threshold goes left.

    A feature's values are cut into range buckets; a bucket is summed on from the totals of those before it, so that a feature
    with many distinct values is many groups. Edges part the work and change no result. Where the values are known to be few
    (not `wide`), one group a feature does.
    """
    keys = [node, "feature"] if node else ["feature"]
    middle = ((F.col("value") + F.col("after")) / 2).alias("threshold")
    if not wide:
        line, every = Window.partitionBy(*keys).orderBy("value"), Window.partitionBy(*keys)
        left = (F.sum(s).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(f"l_{s}") for s in stats)
        rows = counts.select(*keys, "value", *left, *(F.sum(s).over(every).alias(f"t_{s}") for s in stats), F.lead("value").over(line).alias("after"))
        return rows.where("after is not null").select("*", middle)
    n = min(MAX_PARTS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = counts.groupBy("feature").agg(F.percentile_approx("value", [i / n for i in range(1, n)] or [0.5], 1000).alias("__edges"))
    cut = counts.join(F.broadcast(edges), "feature").withColumn("__bucket", F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col("value"))), F.lit(0))).drop("__edges")
    line, every = Window.partitionBy(*keys).orderBy("__bucket"), Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "__bucket").agg(*(F.sum(s).alias(s) for s in stats), F.min("value").alias("__first"))
    ahead = [F.coalesce(F.sum(s).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{s}") for s in stats]
    sums = sums.select(*keys, "__bucket", *ahead, *(F.sum(s).over(every).alias(f"t_{s}") for s in stats), F.lead("__first").over(line).alias("__next"))
    order = Window.partitionBy(*keys, "__bucket").orderBy("value")
    own = cut.select(*keys, "__bucket", "value", *(F.sum(s).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__l_{s}") for s in stats), F.lead("value").over(order).alias("__after"))
    rows = own.join(sums, [*keys, "__bucket"]).withColumn("after", F.coalesce("__after", "__next")).where("after is not null")
    left = (F.col(f"__l_{s}") + F.col(f"__b_{s}") for s in stats)
    return rows.select(*keys, "value", *(c.alias(f"l_{s}") for c, s in zip(left, stats, strict=True)), *(f"t_{s}" for s in stats), "after", middle)


def gini_gain(k: int) -> Column:
    """Weighted Gini decrease from class sums c0..; share of rows on each side."""
    n, left = sum((F.col(f"t_c{i}") for i in range(k)), F.lit(0)), sum((F.col(f"l_c{i}") for i in range(k)), F.lit(0))
    impurity = lambda cols, m: 1 - sum((fn.ratio(c, m, 0.0) * fn.ratio(c, m, 0.0) for c in cols), F.lit(0.0))
    whole = impurity([F.col(f"t_c{i}") for i in range(k)], n)
    a = impurity([F.col(f"l_c{i}") for i in range(k)], left)
    b = impurity([F.col(f"t_c{i}") - F.col(f"l_c{i}") for i in range(k)], n - left)
    return whole - (left * a + (n - left) * b) / n


def variance_gain() -> Column:
    n, s, left, ls = F.col("t_n"), F.col("t_s"), F.col("l_n"), F.col("l_s")
    return (ls * ls / left + (s - ls) * (s - ls) / (n - left) - s * s / n) / n


def second_order_gain(lam: float = 1.0, gamma: float = 0.0) -> Column:
    g, h, gl, hl = F.col("t_g"), F.col("t_h"), F.col("l_g"), F.col("l_h")
    part = lambda a, b: a * a / (b + lam)
    return 0.5 * (part(gl, hl) + part(g - gl, h - hl) - part(g, h)) - gamma


def best_split(splits: DataFrame, gain: Column, node: str | None = None) -> DataFrame:
    """Largest gain; the first feature by name, then the smallest threshold, on ties."""
    keys = [node] if node else []
    scored = splits.withColumn("gain", F.round(gain, 12))
    b = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("gain")).alias("a"), "feature", "threshold", *(c for c in splits.columns if c[:2] in ("l_", "t_")))).alias("b"))
    return b.select(*keys, "b.feature", "b.threshold", (-F.col("b.a")).alias("gain"), *(f"b.{c}" for c in splits.columns if c[:2] in ("l_", "t_")))


@dataclass
class Tree:
    """nodes: id -> (feature, threshold, value); children of i are 2i + 1 and 2i + 2; feature None is a leaf."""

    nodes: dict[int, tuple] = field(default_factory=dict)

    def column(self, i: int = 0, what: str = "value") -> Column:
        feature, threshold, value = self.nodes[i]
        if feature is None:
            return F.lit(i) if what == "node" else F.lit(value)
        return F.when(F.col(feature) <= threshold, self.column(2 * i + 1, what)).otherwise(self.column(2 * i + 2, what))

    def leaves(self) -> list[int]:
        return [i for i, n in self.nodes.items() if n[0] is None]

    def prune(self, alpha: float, risk: dict[int, float], i: int = 0) -> tuple[float, int]:
        """Collapse subtrees whose risk falls by no more than alpha a leaf; (risk, leaves) of what stays."""
        if self.nodes[i][0] is None:
            return risk[i], 1
        a, b = self.prune(alpha, risk, 2 * i + 1), self.prune(alpha, risk, 2 * i + 2)
        r, n = a[0] + b[0], a[1] + b[1]
        if risk[i] - r <= alpha * (n - 1):
            drop = [j for j in self.nodes if j != i and self._under(j, i)]
            for j in drop:
                del self.nodes[j]
            self.nodes[i] = (None, None, self.nodes[i][2])
            return risk[i], 1
        return r, n

    @staticmethod
    def _under(j: int, i: int) -> bool:
        while j > i:
            j = (j - 1) // 2
        return j == i


def grow(df: DataFrame, features: list[str], stats: dict[str, Column], gain: Column, leaf, depth: int = 3, least: int = 1, count: str = "n", min_gain: float = 0.0) -> Tree:
    """A tree level by level: each level is one aggregate over the rows, with the rows' node as an expression of the tree so far.

    leaf: from a dict of summed stats to the node's value.
    """
    first = df.agg(*(F.sum(c).alias(k) for k, c in stats.items()), F.greatest(F.lit(0), *(F.approx_count_distinct(f) for f in features)).alias("__values")).first().asDict()
    wide = first.pop("__values") > ONE_GROUP
    tree = Tree({0: (None, None, leaf(first))})
    open_ = [0]
    for _ in range(depth):
        rows = df.withColumn("__node", tree.column(what="node")).where(F.col("__node").isin(open_))
        splits = split_table(value_counts(rows, features, stats, "__node"), list(stats), "__node", wide)
        splits = splits.where((F.col(f"l_{count}") >= least) & (F.col(f"t_{count}") - F.col(f"l_{count}") >= least))
        found = best_split(splits, gain, "__node").where(F.col("gain") > min_gain).collect()
        open_ = []
        for r in found:
            i = r["__node"]
            left = {k: r[f"l_{k}"] for k in stats}
            right = {k: r[f"t_{k}"] - r[f"l_{k}"] for k in stats}
            tree.nodes[i] = (r["feature"], r["threshold"], tree.nodes[i][2])
            tree.nodes[2 * i + 1], tree.nodes[2 * i + 2] = (None, None, leaf(left)), (None, None, leaf(right))
            open_ += [2 * i + 1, 2 * i + 2]
        if not open_:
            break
    return tree


def classification_tree(df: DataFrame, features: list[str], y: str, classes: list, depth: int = 3, least: int = 1) -> Tree:
    stats = {f"c{i}": (F.col(y) == c).cast("long") for i, c in enumerate(classes)} | {"n": F.lit(1).cast("long")}
    return grow(df, features, stats, gini_gain(len(classes)), lambda s: classes[max(range(len(classes)), key=lambda i: (s[f"c{i}"], -i))], depth, least)


def regression_tree(df: DataFrame, features: list[str], y: str, depth: int = 3, least: int = 1) -> Tree:
    return grow(df, features, {"n": F.lit(1).cast("long"), "s": F.col(y).cast("double")}, variance_gain(), lambda s: s["s"] / s["n"], depth, least)


def forest(df: DataFrame, key: str, features: list[str], y: str, classes: list, trees: int = 10, depth: int = 3, seed: int = 0) -> list[Tree]:
    """Trees on Poisson(1) weights that hash (seed, tree, key); each sees sqrt(d) of the features, by a rotation."""
    m = max(1, round(math.sqrt(len(features))))
    out = []
    for t in range(trees):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(t), key), 11).cast("double") / float(1 << 53)
        w, total = F.lit(0), 0.0
        for k in range(8):
            total += math.exp(-1) / math.factorial(k)
            w = w + (u >= total).cast("int")
        own = [features[(t * m + i) % len(features)] for i in range(m)]
        rows = df.withColumn("__w", w).where("__w > 0")
        stats = {f"c{i}": (F.col(y) == c).cast("long") * F.col("__w") for i, c in enumerate(classes)} | {"n": F.col("__w").cast("long")}
        out.append(grow(rows, own, stats, gini_gain(len(classes)), lambda s: classes[max(range(len(classes)), key=lambda i: (s[f"c{i}"], -i))], depth))
    return out


def majority(trees: list[Tree], classes: list) -> Column:
    votes = [F.struct((-sum(((t.column() == F.lit(c)).cast("int") for t in trees), F.lit(0))).alias("v"), F.lit(i).alias("i")) for i, c in enumerate(classes)]
    return F.get(F.array(*map(F.lit, classes)), F.array_min(F.array(*votes))["i"])


def boosted(df: DataFrame, features: list[str], y: str, loss: str = "squared", rounds: int = 10, rate: float = 0.3, depth: int = 3, lam: float = 1.0, gamma: float = 0.0) -> list[Tree]:
    """Second-order boosting for squared or logistic loss: the margin so far is an expression over the trees, so a round reads the rows once a level."""
    base = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    start = base if loss == "squared" else math.log(max(base, 1e-6) / max(1 - base, 1e-6))
    trees = [Tree({0: (None, None, start)})]
    for _ in range(rounds):
        f = margin(trees, rate)
        if loss == "squared":
            g, h = f - F.col(y), F.lit(1.0)
        else:
            p = fn.sigmoid(f)
            g, h = p - F.col(y), p * (1 - p)
        rows = df.select(*features, g.alias("__g"), h.alias("__h"))
        stats = {"g": F.col("__g"), "h": F.col("__h"), "n": F.lit(1).cast("long")}
        trees.append(grow(rows, features, stats, second_order_gain(lam, gamma), lambda s: -s["g"] / (s["h"] + lam), depth))
    return trees


def margin(trees: list[Tree], rate: float) -> Column:
    return sum((rate * t.column() for t in trees[1:]), F.lit(float(trees[0].nodes[0][2])))


def weighted_stump(df: DataFrame, features: list[str], y: str, weight: str) -> DataFrame:
    """Depth-1 split of least weighted error for labels -1 and 1: feature, threshold, polarity (sign on the left), error."""
    counts = value_counts(df, features, {"p": F.when(F.col(y) == 1, F.col(weight)).otherwise(0.0), "m": F.when(F.col(y) == -1, F.col(weight)).otherwise(0.0)})
    s = split_table(counts, ["p", "m"])
    total = F.col("t_p") + F.col("t_m")
    left_minus = (F.col("l_p") + F.col("t_m") - F.col("l_m")) / total
    s = s.withColumn("error", F.round(F.least(left_minus, 1 - left_minus), 12)).withColumn("polarity", F.when(left_minus <= 1 - left_minus, -1).otherwise(1))
    return s.agg(F.min(F.struct("error", "feature", "threshold", "polarity")).alias("b")).select("b.feature", "b.threshold", "b.polarity", "b.error")


def adaboost(df: DataFrame, features: list[str], y: str, rounds: int = 5) -> list[tuple]:
    """(alpha, feature, threshold, polarity): weights follow from the margin expression and are never stored."""
    model: list[tuple] = []
    for _ in range(rounds):
        w = F.exp(-F.col(y) * stump_sum(model))
        r = weighted_stump(df.withColumn("__w", w), features, y, "__w").first()
        e = min(max(r["error"], 1e-10), 1 - 1e-10)
        model.append((0.5 * math.log((1 - e) / e), r["feature"], r["threshold"], r["polarity"]))
    return model


def stump_sum(model: list[tuple]) -> Column:
    return sum((a * F.when(F.col(f) <= t, p).otherwise(-p) for a, f, t, p in model), F.lit(0.0))


def permutation_importance(df: DataFrame, predict: Column, y: str, features: list[str], key: str, seed: int = 0) -> dict[str, float]:
    """Accuracy lost when a feature's values are dealt anew: rows trade values with the next row in hash order."""
    from .ordered import numbered

    base = df.agg(F.avg((predict == F.col(y)).cast("double"))).first()[0]
    out = {}
    for f in features:
        order = numbered(df.withColumn("__h", F.xxhash64(F.lit(seed), key).cast("double")), "__h", "__r", (key,))
        n = order.count()
        moved = order.select(((F.col("__r") % n) + 1).alias("__r"), F.col(f).alias("__v"))
        shuffled = order.drop(f).join(moved, "__r").withColumnRenamed("__v", f)
        out[f] = base - shuffled.agg(F.avg((predict == F.col(y)).cast("double"))).first()[0]
    return out


def loss_starts(df: DataFrame, y: str, huber_share: float = 0.9, tau: float = 0.5) -> DataFrame:
    """loss, start (the best constant), value (mean loss there) and gradient (mean negative gradient) of squared, absolute, huber and quantile losses."""
    c = df.agg(F.avg(y).alias("sq"), F.median(y).alias("md"), F.percentile(y, F.lit(tau)).alias("q"))
    rows = df.select(y).join(F.broadcast(c))
    rows = rows.join(F.broadcast(rows.agg(F.percentile(F.abs(F.col(y) - F.col("md")), F.lit(huber_share)).alias("h"))))
    a, b, q, h = F.col(y) - F.col("sq"), F.col(y) - F.col("md"), F.col(y) - F.col("q"), F.col("h")
    kinds = {
        "squared": ("sq", a * a / 2, a), "absolute": ("md", F.abs(b), F.signum(b)),
        "huber": ("md", F.when(F.abs(b) <= h, b * b / 2).otherwise(h * (F.abs(b) - h / 2)), F.greatest(F.least(b, h), -h)),
        "quantile": ("q", F.when(q > 0, tau * q).otherwise((tau - 1) * q), F.when(q > 0, F.lit(tau)).otherwise(F.lit(tau - 1))),
    }
    row = rows.agg(*(f for k, (s, v, g) in kinds.items() for f in (F.max(s).alias(f"{k}_s"), F.avg(v).alias(f"{k}_v"), F.avg(g).alias(f"{k}_g"))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("loss"), F.col(f"{k}_s").alias("start"), F.col(f"{k}_v").alias("value"), F.col(f"{k}_g").alias("gradient")) for k in kinds))).alias("x")).select("x.*")


def histogram_gains(df: DataFrame, features: list[str], g: str, h: str, bins: int = 64, lam: float = 1.0, min_child_weight: float = 1.0) -> DataFrame:
    """feature, bin, gain of a split after each bin of exact quantiles: one row a bin is all that a feature's window holds."""
    edges = df.agg(*(F.array_distinct(F.percentile(f, F.array(*(F.lit(i / bins) for i in range(1, bins))))).alias(f"e_{f}") for f in features))
    rows = df.join(F.broadcast(edges))
    below = lambda f: F.size(F.filter(f"e_{f}", lambda e: e <= F.col(f)))
    place = F.array(*(F.struct(F.lit(f).alias("feature"), below(f).alias("bin")) for f in features))
    sums = rows.select(F.explode(place).alias("x"), F.col(g).alias("g"), F.col(h).alias("h")).groupBy("x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    left, whole = Window.partitionBy("feature").orderBy("bin"), Window.partitionBy("feature")
    c = sums.select("feature", "bin", F.sum("g").over(left).alias("gl"), F.sum("h").over(left).alias("hl"), F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"))
    part = lambda a, b: a * a / (b + lam)
    gain = 0.5 * (part(F.col("gl"), F.col("hl")) + part(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - part(F.col("g"), F.col("h")))
    return c.where((F.col("hl") >= min_child_weight) & (F.col("h") - F.col("hl") >= min_child_weight)).select("feature", "bin", gain.alias("gain"))


def samme_step(df: DataFrame, left: Column, label: str, weight: str, classes: int) -> DataFrame:
    """error, alpha and wrong_share (weight of the wrong rows after the step) of a stump that votes for each side's heaviest class."""
    n = df.groupBy(left.alias("side"), F.col(label).alias("c")).agg(F.sum(weight).alias("w"))
    votes = n.groupBy("side").agg(F.min(F.struct((-F.col("w")).alias("w"), "c")).alias("b")).select("side", F.col("b.c").alias("vote"))
    e = n.join(F.broadcast(votes), "side").agg((F.sum(F.when(F.col("c") != F.col("vote"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("error"))
    e = e.withColumn("error", F.greatest(F.least("error", F.lit(1 - 1e-10)), F.lit(1e-10))).withColumn("alpha", F.ln((1 - F.col("error")) / F.col("error")) + math.log(classes - 1))
    up = F.col("error") * F.exp("alpha")
    return e.select("error", "alpha", (up / (up + 1 - F.col("error"))).alias("wrong_share"))
