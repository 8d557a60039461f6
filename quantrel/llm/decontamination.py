r"""Operator 4: benchmark decontamination by winnowing, in DataFrame expressions only.

Texts become words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased. A window is WINDOW
consecutive words of a benchmark item; an item of fewer words is one window. Of each WINDOW-word
stretch, winnowing keeps the smallest hash among its GRAM-word grams. A stretch that a document
shares with an item has the same grams, hence the same kept hash at the same place in it, so every
shared window meets in the join of the kept hashes. Each meeting is then extended to the whole window,
word by word, so no hash collision can report a hit. Short items are met by a gram of their own length.

A kept gram that passes a bit table of the benchmark's hashes goes on with the words around it alone, so the work grows with the text and not with its square. The benchmark's
table is broadcast while it has at most BROADCAST_ROWS rows (counted before); beyond that the same rows meet it in a shuffled
join, in which each row's marker is spread by the hash of its key.

Defined cases: null and empty texts have no words and no hits. Repeated rows each get their own row. Null
ids are kept as ids; items with null id count as no item in n_items. An empty benchmark hits nothing.
Extra columns, whatever their names, pass through drop_contaminated().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lower_ascii, materialise, reserve, split_words, table, upto

WINDOW, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longs of the bit table of benchmark hashes that grams are tried against first.
FILTER_WORDS = 4096
#: Rows of the benchmark's fingerprint table that may be broadcast (about 150 bytes each).
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS)


def gram_hash(words: Column, i: Column, size: int, window: int) -> Column:
    return F.xxhash64(F.lit(window), *(F.get(words, i + j) for j in range(size)))


def kept_grams(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """array<struct<h,p>>: for each run of `window` words the smallest gram hash (leftmost on ties), each place once."""
    grams = F.transform(upto(F.size(words) - (gram - 1)), lambda i: F.struct(gram_hash(words, i, gram, window).alias("h"), i.alias("p")))
    minima = let(grams, lambda g: F.transform(upto(F.size(words) - (window - 1)), lambda j: F.array_min(F.slice(g, j + 1, window - gram + 1))))
    return let(minima, lambda m: F.filter(m, lambda x, j: (j == 0) | (F.get(m, j - 1)["p"] != x["p"])))


def short_grams(words: Column, window: int) -> Column:
    """Every run of `window` words, for items that have no more."""
    return F.transform(upto(F.size(words) - (window - 1)), lambda i: F.struct(gram_hash(words, i, window, window).alias("h"), i.alias("p")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """h, q (place of the gram in the window), size, body (the window's words), set_id, items (ids as sorted strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    whole = F.least(n, F.lit(WINDOW))
    bodies = F.transform(upto(n - whole + 1), lambda i: F.slice("w", i + 1, whole))
    spread = items.select("item", F.explode(F.array_distinct(bodies)).alias("b")).groupBy("b").agg(F.array_sort(F.collect_set("item")).alias("items"))
    kept = F.when(F.size("b") == WINDOW, kept_grams(F.col("b")).getItem(0))
    for size in range(1, WINDOW):
        kept = kept.when(F.size("b") == size, short_grams(F.col("b"), size).getItem(0))
    spread = spread.withColumn("g", kept)
    return spread.select(F.col("g.h").alias("h"), F.col("g.p").alias("q"), F.size("b").alias("size"), F.concat_ws(" ", "b").alias("body"), F.xxhash64("items").alias("set_id"), "items")


def hash_filter(windows: DataFrame) -> Callable[[Column], Column]:
    """A test that every hash of the benchmark passes, and few others while it has fewer rows than the filter bits: FILTER_WORDS longs, whatever the benchmark."""
    word, bit = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int"), lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    set_ = windows.groupBy(word(F.col("h")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))).alias("bits")).collect()
    bits = [0] * FILTER_WORDS
    for r in set_:
        bits[r["word"]] = r["bits"]
    table_ = F.lit(np.array(bits, np.int64))
    return lambda h: F.call_function("shiftright", F.get(table_, word(h)), bit(h)).bitwiseAND(F.lit(1)) == 1


def hits(docs: DataFrame, key: list[str], text: str, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each distinct key: mult (rows), n_words, spans (array of start * 16 + size), sets (item sets met)."""
    sizes, maybe = sorted(r[0] for r in windows.select("size").distinct().collect()), hash_filter(windows)
    rows = docs.select(*key, words_of(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    w = F.col("w")
    def around(size: int) -> Column:
        """The kept grams that the filter lets through, each with the words that a window over it can hold."""
        grams, before, after = (kept_grams(w), WINDOW - GRAM, WINDOW) if size == WINDOW else (short_grams(w, size), 0, size)
        first = lambda p: F.greatest(p - before, F.lit(0))
        return F.transform(F.filter(grams, lambda g: maybe(g["h"])), lambda g: F.struct(g["h"].alias("h"), g["p"].alias("p"), first(g["p"]).alias("f"), F.slice(w, first(g["p"]) + 1, before + after).alias("c")))

    none = F.array().cast("array<struct<h:bigint,p:int,f:int,c:array<string>>>")
    marker = F.array(F.struct(F.xxhash64(*key).alias("h"), F.lit(-1).alias("p"), F.lit(0).alias("f"), F.array().cast("array<string>").alias("c")))
    rows = rows.select(*key, "n", F.explode(F.concat(marker, none, *map(around, sizes))).alias("g")).select(*key, "n", "g.h", "g.p", "g.f", "g.c")
    table_ = windows.select(F.col("h").alias("bh"), "q", "size", "body", "set_id")
    if windows.count() <= broadcast_rows:
        table_ = F.broadcast(table_)
    start = F.col("p") - F.col("q")
    met = rows.join(table_, F.col("h") == F.col("bh"), "left")
    true = (start >= 0) & (F.concat_ws(" ", F.slice("c", F.greatest(start - F.col("f"), F.lit(0)) + 1, F.col("size"))) == F.col("body"))
    met = met.select(*key, "n", "p", F.when(true, start * 16 + F.col("size")).alias("span"), F.when(true, F.col("set_id")).alias("set_id"), (F.col("p") == -1).alias("marker"))
    met = met.where(F.col("marker") | F.col("span").isNotNull())
    return met.groupBy(*key).agg(F.sum(F.col("marker").cast("long")).alias("mult"), F.max("n").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("set_id").alias("sets"))


def covered(spans: Column) -> Column:
    """Distinct word places inside the spans."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(F.shiftright(s, 4), F.shiftright(s, 4) + s.bitwiseAND(F.lit(15)) - 1)))))


def report(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row for each row of docs."""
    windows = materialise(benchmark_windows(benchmark), "benchmark-windows")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.spark_partition_id().alias("part"))
    found = materialise(hits(keyed, ["part", "doc_id", "th"], "text", windows, broadcast_rows), "benchmark-hits")
    sets = windows.select("set_id", F.explode("items").alias("item")).distinct()
    met = found.where(F.size("sets") > 0).select("part", "doc_id", "th", F.explode("sets").alias("set_id")).join(sets, "set_id")
    items = met.groupBy("part", "doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select(F.col("part").alias("ipart"), F.col("doc_id").alias("idoc"), F.col("th").alias("ith"), "items")
    same = (F.col("part") == F.col("ipart")) & F.col("doc_id").eqNullSafe(F.col("idoc")) & (F.col("th") == F.col("ith"))
    out = found.join(items, same, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.select("doc_id", F.col("n_words").cast("long"), covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "mult")
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult")))).drop("mult", "copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that hold no benchmark window; columns as they were.

    Hits are found by text, so rows with equal texts share their verdict, whatever their ids.
    """
    windows = materialise(benchmark_windows(benchmark), "benchmark-windows")
    n = reserve(docs, "th", "len")
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    texts = texts.select("t", F.xxhash64("t").alias("th"), F.length("t").alias("len"))
    bad = hits(texts, ["th", "len"], "t", windows, broadcast_rows).where(F.size("spans") > 0).select(F.col("th").alias(n["th"]), F.col("len").alias(n["len"]))
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = docs.withColumn(n["th"], F.xxhash64(own)).withColumn(n["len"], F.length(own))
    return marked.join(materialise(bad, "benchmark-bad"), [n["th"], n["len"]], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT rid, item, n, p FROM dw JOIN iw USING (n, k)),
pos AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM met) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM met WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
