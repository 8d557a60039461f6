"""Operator 8: sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A row descends region, rack and shard. At each node every child draws ln(u) / weight, where u is a
uniform hash of (key, level, child), and the largest draw wins. A child's draw depends on nothing but key, child
and weight, so a change of weights moves rows only into subtrees whose weight rose or out of those whose
weight fell. Shards are laid out RACK to a rack and RACKS to a region; from 40 shards, one more opens a
region of its own, so it takes rows only into itself. The law is therefore `key`.

Slots number a shard's rows from 0 without a gap and without bringing a shard into one task: equal rows are first
counted, shards are cut into hash buckets of about BUCKET_ROWS rows, and a bucket's rows are numbered from the sum of
the buckets before it.

Defined cases: a null text has no bytes (size 16) and crc32 0. A null key hashes like a key of its own. Equal rows are
interchangeable and get a slot each. An empty table gives an empty result. Extra columns pass through assign().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, reserve, table

SHARDS, RACK, RACKS = 40, 5, 4
OVERHEAD = 16
BUCKET_ROWS = 20_000


def tree(weights: list[float]) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight, without what weighs nothing."""
    out: dict = {}
    for shard, weight in enumerate(weights):
        if weight > 0:
            rack = shard // RACK
            out.setdefault(rack // RACKS, {}).setdefault(rack, {})[shard] = float(weight)
    return out


def winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    def draw(node: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.ln(u) / F.lit(weight)).alias("draw"), F.lit(node).alias("node"))

    return F.array_max(F.array(*(draw(n, w) for n, w in weights.items()))).getField("node")


def assign(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """Adds the shard of each row; key and weights alone decide."""
    nodes, n, k = tree(weights), reserve(df, "region", "rack"), F.col(f"`{key}`")
    regions = {r: sum(sum(x.values()) for x in racks.values()) for r, racks in nodes.items()}
    rack, shard = F, F
    for r, racks in nodes.items():
        rack = rack.when(F.col(n["region"]) == r, winner(k, "rack", {i: sum(x.values()) for i, x in racks.items()}))
        for i, shards in racks.items():
            shard = shard.when(F.col(n["rack"]) == i, winner(k, "shard", shards))
    return df.withColumn(n["region"], winner(k, "region", regions)).withColumn(n["rack"], rack).withColumn(out, shard).drop(*n.values())


def numbered(rows: DataFrame, shard: str, count: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds `slot` to rows, whose columns together decide the order within a shard (by hash bucket, then by value)."""
    shards, cols, n = max(1, rows.select(shard).distinct().count()), rows.columns, reserve(rows, "mult", "bucket", "before", "n", "within", "copy")
    buckets = max(1, math.ceil(count / (shards * bucket_rows)))
    own = [F.col(f"`{c}`") for c in cols]
    once = rows.groupBy(*own).agg(F.count(F.lit(1)).alias(n["mult"])).withColumn(n["bucket"], F.pmod(F.xxhash64(*own), F.lit(buckets)))
    once = materialise(once, "shard-rows")
    before = once.groupBy(shard, n["bucket"]).agg(F.sum(n["mult"]).alias(n["n"]))
    before = before.withColumn(n["before"], F.sum(n["n"]).over(Window.partitionBy(shard).orderBy(n["bucket"])) - F.col(n["n"])).drop(n["n"])
    within = F.sum(n["mult"]).over(Window.partitionBy(shard, n["bucket"]).orderBy(*own).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n["mult"])
    placed = once.withColumn(n["within"], within).join(before, [shard, n["bucket"]])
    placed = placed.withColumn(n["copy"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(n["mult"]) - 1)))
    return placed.select(*own, (F.col(n["before"]) + F.col(n["within"]) + F.col(n["copy"])).alias("slot"))


def op8_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, "doc_id", [1.0] * SHARDS), "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return numbered(rows.select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard"), "shard", docs.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
