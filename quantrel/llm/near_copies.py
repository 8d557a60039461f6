"""Near copies by word shingles: SimHash and minimum hashes find the candidates, exact similarity decides.

A text's set is the XXH64 (seed 42) of its distinct SHINGLE-word shingles (a text of fewer words is one shingle). Texts with a
similarity (shared over all shingles) of SIMILARITY or more are linked. Candidates are the members of a SimHash component: the sets' fingerprints
go through op10's distance tables to pivots and its components. What lies beyond its radius shares one of BANDS keys, each of ROWS minimum hashes: two
texts of similarity s share none with a chance of (1 - s**4)**32, 5e-8 at 0.8. Every candidate pair is then compared by its whole sets.

A cell (a SimHash component, or an equal key) of over CELL sets is not paired at once: its members are compared with the smallest and with the next, and pairs of
the cell that the components found so far leave apart are compared afterwards, so nothing is left out. Equal sets are one vertex and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, one_of_each, reserve
from .components import components
from .simhash import link_table, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, CELL = 32, 4, 48
DRAWS = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64)
MULTIPLIERS, OFFSETS = DRAWS[0][:, None] | np.uint64(1), DRAWS[1][:, None]


def shingle_set(text: Column, size: int = SHINGLE) -> Column:
    return F.array_distinct(shingle_hashes(text, size))


def least_hashes(own: np.ndarray) -> np.ndarray:
    """A key for each band, of its ROWS minima of the set's hashes under permutations a * h + b of 64 bits."""
    h = own.view(np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, (MULTIPLIERS * h[i : i + 2048] + OFFSETS).min(1), out=least)
    least ^= least >> np.uint64(29)
    return (least.reshape(BANDS, ROWS) * MULTIPLIERS[:ROWS, 0]).sum(1, dtype=np.uint64).view(np.int64)


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of a set: a bit is set where over half of the hashes have it set."""
    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(own), bitorder="little").view(np.int64)


def sketches(sets: Column) -> Column:
    """The fingerprint of each set, then its band keys."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.concatenate([fingerprint(h), least_hashes(h)]) for h in (np.array(x, np.int64) for x in batch)])

    return keys(F.transform(sets, lambda h: F.coalesce(h, F.lit(0).cast("long"))))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets are as similar as that."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("s").alias(f"s{side}")), side)
    shared, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return pairs.where(shared >= F.lit(similarity) * (both - shared) - 1e-9).select("a", "b")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of linked texts: that of the smallest id (null ids last), then of the smallest hash of its text; columns as they were.

    Of rows that repeat both, that of the smallest hash of all its columns stays.
    """
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    hashed = rows.select("id", "th", shingle_set(F.col("t"), size).alias("s")).select("id", "th", F.xxhash64(F.array_sort("s")).alias("node"), sketches(F.col("s")).alias("k")).select("id", "th", "node", F.col("k")[0].alias("fp"), F.slice("k", 2, BANDS).alias("keys"))
    own = materialise(hashed, "near-keys")
    nodes = own.groupBy("node").agg(F.min("th").alias("th"))
    placed = own.select("node", F.posexplode("keys").alias("band", "key")).distinct()
    prints = materialise(own.select("node", "fp").distinct(), "near-prints")
    met = materialise(components(link_table(prints.select("fp").distinct())), "near-simhash").withColumnRenamed("v", "fp")
    alike = prints.join(met, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.array_sort(F.collect_list("node")).alias("m"))
    shared = placed.groupBy("band", "key").agg(F.array_sort(F.collect_list("node")).alias("m"))
    members = materialise(alike.select("m").union(shared.select("m")).where(F.size("m") > 1).distinct(), "near-cells")
    light, heavy = members.where(F.size("m") <= CELL), members.where(F.size("m") > CELL)
    pairs = light.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    first = heavy.select(F.col("m")[0].alias("a"), F.explode("m").alias("b"))
    chain = heavy.select(F.posexplode("m").alias("i", "b"), "m").where(F.col("i") > 0).select(F.expr("m[i - 1]").alias("a"), "b")
    pairs = materialise(pairs.union(first).union(chain).where(F.col("a") != F.col("b")).distinct(), "near-pairs")
    asked = members.select(F.explode("m").alias("node")).distinct().join(nodes, "node")
    texts = rows.select("th", "t").join(asked, "th").dropDuplicates(["node"])
    sets = materialise(texts.select("node", shingle_set(F.col("t"), size).alias("s")), "near-sets")
    links = materialise(similar(pairs, sets, similarity), "near-links")
    found = materialise(components(links), "near-roots")

    at = heavy.select(F.monotonically_increasing_id().alias("cell"), F.explode("m").alias("v")).join(found, "v", "left").withColumn("root", F.coalesce("root", "v"))
    groups = materialise(at.groupBy("cell", "root").agg(F.collect_list("v").alias("g")), "near-groups")
    x, y = groups.alias("x"), groups.alias("y")
    apart = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.root") < F.col("y.root"))).select(F.explode("x.g").alias("a"), F.col("y.g").alias("g")).select("a", F.explode("g").alias("b")).distinct()
    late = materialise(similar(apart, sets, similarity), "near-late")
    if not late.isEmpty():
        found = materialise(components(links.union(late)), "near-roots")

    n = reserve(df, "id", "th", "own")
    rooted = own.join(found.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "th")).alias("b"))
    keep = best.select(F.col("b.id").alias(n["id"]), F.col("b.th").alias(n["th"]))
    marked = df.withColumn(n["own"], F.xxhash64(F.col(f"`{text}`").cast("string")))
    kept = marked.join(keep, F.col(f"`{id_column}`").eqNullSafe(F.col(n["id"])) & (F.col(n["own"]) == F.col(n["th"])), "left_semi")
    return one_of_each(kept, [id_column, n["own"]]).drop(n["own"])
