"""Frequent itemsets level by level, and the rules in them."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantrel import functions as fn

from .storage import cut


def frequent_itemsets(baskets: DataFrame, basket: str, item: str, min_support: float, levels: int | None = None) -> DataFrame:
    """items (sorted array), size, n, support >= min_support (inclusive), of any size: levels go on until one is empty, or up to `levels` where that is given.

    A level's candidates come from frequent sets that share all but their last item, pruned by an all-subsets check. The sets that a
    basket holds grow from those it held a level before by one item of its own, so the rows follow what occurs in baskets.
    """
    pairs = baskets.select(F.col(basket).alias("b"), F.col(item).alias("i")).distinct()
    n = pairs.select("b").distinct().count()
    floor = min_support * n - 1e-9
    found = cut(pairs.groupBy(F.array("i").alias("items")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor))
    held = cut(pairs.join(found.select(F.col("items")[0].alias("i")), "i"))
    within, out = held.select("b", F.array("i").alias("items")), [found]
    for k in count(2):
        if levels is not None and k > levels:
            break
        head = lambda d, s: d.select(F.slice("items", 1, k - 2).alias("head"), F.element_at("items", -1).alias(s), F.col("items").alias(f"all_{s}"))
        joined = head(found, "x").join(head(found, "y"), "head").where("x < y").select(F.concat("all_x", F.array("y")).alias("items"))
        subsets = joined.select("items", F.explode(F.transform("items", lambda i: F.array_remove("items", i))).alias("sub"))
        whole = subsets.join(found.select(F.col("items").alias("sub")), "sub").groupBy("items").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") == k)
        candidates = whole.select(F.slice("items", 1, k - 1).alias("head"), F.element_at("items", -1).alias("i"), "items")
        longer = within.withColumnRenamed("items", "head").join(held, "b").where(F.col("i") > F.element_at("head", -1))
        within = longer.join(candidates, ["head", "i"]).select("b", "items")
        found = cut(within.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor))
        within = within.join(found.select("items"), "items", "left_semi").select("b", "items")
        if not found.limit(1).count():
            break
        out.append(found)
    return reduce(DataFrame.union, out).select("items", F.size("items").alias("size"), "n", (F.col("n") / n).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """antecedent, consequent, support, confidence (inclusive bound), lift: every split of every itemset."""
    sets = itemsets.where(F.size("items") > 1)
    masks = F.sequence(F.lit(1), F.expr("shiftleft(1, size(items)) - 2"))
    split = sets.select("items", "support", F.explode(masks).alias("m"))
    ante = F.transform(F.filter(F.transform("items", lambda x, i: F.struct(x.alias("x"), F.col("m").alias("m"), i.alias("i"))), lambda s: F.floor(s["m"] / F.pow(F.lit(2.0), s["i"])) % 2 == 1), lambda s: s["x"])
    split = split.withColumn("antecedent", ante).withColumn("consequent", F.array_except("items", "antecedent"))
    side = lambda name, s: itemsets.select(F.col("items").alias(name), F.col("support").alias(s))
    r = split.join(side("antecedent", "sa"), "antecedent").join(side("consequent", "sc"), "consequent")
    r = r.withColumn("confidence", F.col("support") / F.col("sa")).where(F.col("confidence") >= min_confidence - 1e-12)
    return r.select("antecedent", "consequent", "support", "confidence", fn.ratio(F.col("confidence"), F.col("sc")).alias("lift"))
