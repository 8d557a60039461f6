"""Tokens, n-grams, TF-IDF, co-occurrence, merges of byte-pair encoding, and text comparison scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantrel import functions as fn


def words(text: Column) -> Column:
    """Lower-cased, split on white space."""
    return F.array_remove(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"), "")


def ngrams(tokens: Column, n: int) -> Column:
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def counted(df: DataFrame, key: str, grams: Column, out: str = "tf") -> DataFrame:
    """key, tok, tf."""
    return df.select(key, F.explode(grams).alias("tok")).groupBy(key, "tok").agg(F.count(F.lit(1)).alias(out))


def vocabulary(df: DataFrame, key: str, grams: Column) -> DataFrame:
    """tok with the (key, place) where it is first seen: ids follow that order."""
    return df.select(key, F.posexplode(grams).alias("p", "tok")).groupBy("tok").agg(F.min(F.struct(key, "p")).alias("first_seen"))


def tfidf(tf: DataFrame, key: str, documents: int) -> DataFrame:
    """key, tok, weight: tf * (ln((1 + n) / (1 + df)) + 1), rows of unit length."""
    df_ = tf.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df_, "tok").withColumn("w", F.col("tf") * (F.ln((1.0 + documents) / (1 + F.col("df"))) + 1))
    norm = F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))), F.lit(1e-12))
    return w.select(key, "tok", (F.col("w") / norm).alias("weight"))


def best_terms(weights: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("weight"), "tok")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cooccurrence(df: DataFrame, tokens: Column, window: int = 2) -> DataFrame:
    """centre, context, n: pairs of places at most `window` apart, in both directions. Ordered pairs are counted once for each gap, in place, and the
    counts are mirrored afterwards."""
    gap = lambda k: F.zip_with(F.slice("__t", 1, F.greatest(F.size("__t") - k, F.lit(0))), F.slice("__t", k + 1, F.greatest(F.size("__t") - k, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = df.select(tokens.alias("__t")).where(F.size("__t") > 1)
    pairs = rows.select(F.explode(F.concat(*(F.filter(gap(k), lambda x: x["a"].isNotNull() & x["b"].isNotNull()) for k in range(1, window + 1)))).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct(F.col("a").alias("centre"), F.col("b").alias("context"), "n"), F.struct(F.col("b").alias("centre"), F.col("a").alias("context"), "n")))
    return pairs.select(both.alias("x")).select("x.*").groupBy("centre", "context").agg(F.sum("n").alias("n"))


def symbol_counts(word_freq: DataFrame, symbols: str, freq: str) -> DataFrame:
    """Frequency-weighted adjacent symbol pairs."""
    two = F.transform(F.filter(F.sequence(F.lit(0), F.size(symbols)), lambda i: i < F.size(symbols) - 1), lambda i: F.struct(F.get(symbols, i).alias("a"), F.get(symbols, i + 1).alias("b")))
    return word_freq.select(F.explode(two).alias("p"), freq).groupBy("p.a", "p.b").agg(F.sum(freq).alias("n"))


def learn_merges(word_freq: DataFrame, word: str, freq: str, merges: int) -> list[tuple[str, str]]:
    """Byte-pair merges: the most frequent pair each round, the lexicographically largest on ties. The table of distinct words shrinks in symbols only."""
    from .storage import cut

    rows = word_freq.select(F.concat(F.split(F.col(word), ""), F.array(F.lit("</w>"))).alias("s"), freq)
    rows = cut(rows.select(F.array_remove("s", "").alias("s"), freq))
    out = []
    for i in range(merges):
        best = symbol_counts(rows, "s", freq).agg(F.max(F.struct("n", "a", "b")).alias("m")).first()["m"]
        if best is None:
            break
        a, b = best["a"], best["b"]
        out.append((a, b))
        joined = F.aggregate("s", F.array().cast("array<string>"), lambda acc, x: F.when((x == b) & (F.try_element_at(acc, F.lit(-1)) == a), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x))))
        rows = rows.select(F.when(F.array_contains("s", a) & F.array_contains("s", b), joined).otherwise(F.col("s")).alias("s"), freq)
        if i % 3 == 2:
            rows = cut(rows)
    return out


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies merges, lowest rank first and leftmost on ties."""
    s = [*word, "</w>"]
    while len(s) > 1:
        rank, i = min((ranks.get((s[i], s[i + 1]), len(ranks)), i) for i in range(len(s) - 1))
        if rank == len(ranks):
            break
        s[i : i + 2] = [s[i] + s[i + 1]]
    return s


def decode_symbols(symbols: list[str]) -> str:
    return "".join(symbols).replace("</w>", " ").rstrip()


def char_ngrams(word: Column, n: int = 3) -> Column:
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    count = F.length(marked) - (n - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(marked, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    return fn.ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 0.0)


def overlap(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """key, both (multiset intersection), na, nb: the grams of both sides are counted in one grouping, without a join."""
    side = lambda g, of: F.transform(g, lambda x: F.struct(x.alias("tok"), F.lit(of).alias("of")))
    rows = df.select(key, F.explode(F.concat(side(a, 0), side(b, 1))).alias("x")).groupBy(key, "x.tok").agg(F.count_if(F.col("x.of") == 0).alias("ca"), F.count_if(F.col("x.of") == 1).alias("cb"))
    return rows.groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("both"), F.sum("ca").alias("na"), F.sum("cb").alias("nb"))


def rouge_n(df: DataFrame, key: str, reference: str, hypothesis: str, n: int) -> DataFrame:
    """key, recall of the reference's n-grams."""
    o = overlap(df, key, ngrams(words(F.col(reference)), n), ngrams(words(F.col(hypothesis)), n))
    return o.select(key, fn.ratio(F.col("both"), F.col("na"), 0.0).alias(f"rouge_{n}"))


def bleu(df: DataFrame, key: str, reference: str, hypothesis: str, top: int = 4) -> DataFrame:
    """key, p1.., brevity and bleu; 0 where any precision is 0, without smoothing."""
    rows = df.select(key, words(F.col(reference)).alias("r"), words(F.col(hypothesis)).alias("h")).withColumn("rl", F.size("r")).withColumn("hl", F.size("h"))
    side = lambda c, n, of: F.transform(ngrams(F.col(c), n), lambda x: F.struct(F.lit(n).alias("n"), x.alias("tok"), F.lit(of).alias("of")))
    grams = rows.select(key, F.explode(F.concat(*(side(c, n, of) for n in range(1, top + 1) for of, c in enumerate(("r", "h"))))).alias("x"))
    counts = grams.groupBy(key, "x.n", "x.tok").agg(F.count_if(F.col("x.of") == 0).alias("cr"), F.count_if(F.col("x.of") == 1).alias("ch"))
    by = counts.groupBy(key).agg(*(fn.ratio(F.sum(F.when(F.col("n") == n, F.least("cr", "ch"))), F.sum(F.when(F.col("n") == n, F.col("ch"))), 0.0).alias(f"p{n}") for n in range(1, top + 1)))
    out = rows.select(key, "rl", "hl").join(by, key, "left").na.fill(0.0, [f"p{n}" for n in range(1, top + 1)])
    brevity = F.when(F.col("hl") == 0, 0.0).when(F.col("hl") >= F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.greatest(F.col("hl"), F.lit(1))))
    mean = F.exp(sum((F.ln(F.when(F.col(f"p{n}") > 0, F.col(f"p{n}"))) for n in range(1, top + 1)), F.lit(0.0)) / top)
    return out.withColumn("brevity", brevity).withColumn("bleu", F.coalesce(F.col("brevity") * mean, F.lit(0.0)))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays: a row of the table is an array, built from the one before."""
    start = F.transform(b, lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        steps = F.aggregate(
            F.zip_with(b, prev, lambda y, up: F.struct(y.alias("y"), up.alias("up"))), F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("diagonal"), F.lit(0).alias("left")),
            lambda acc, e: fn.let(F.when(e["y"] == x, acc["diagonal"] + 1).otherwise(F.greatest(e["up"], acc["left"])), lambda v: F.struct(F.concat(acc["row"], F.array(v)).alias("row"), e["up"].alias("diagonal"), v.alias("left"))),
        )
        return steps["row"]

    return F.coalesce(F.element_at(F.aggregate(a, start, row), -1), F.lit(0))


def rouge_l(reference: Column, hypothesis: Column) -> Column:
    return fn.ratio(lcs_length(words(reference), words(hypothesis)), F.size(words(reference)), 0.0)


def normalized(text: Column) -> Column:
    """Lower case, without . and , and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[.,]", ""), r"\s+", " "))


def answer_scores(df: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """key, exact_match and token F1 (0 where nothing is shared)."""
    rows = df.select(key, normalized(F.col(predicted)).alias("p"), normalized(F.col(gold)).alias("g"))
    o = overlap(rows, key, words(F.col("p")), words(F.col("g")))
    return rows.select(key, (F.col("p") == F.col("g")).cast("int").alias("exact_match")).join(o.select(key, fn.ratio(2 * F.col("both"), F.col("na") + F.col("nb"), 0.0).alias("f1")), key, "left").na.fill(0.0, ["f1"])


def spans_from_bio(df: DataFrame, key: str, place: str, tag: str) -> DataFrame:
    """key, kind, start, stop (exclusive): a span starts at B-, and goes on over I- of its kind."""
    w = Window.partitionBy(key).orderBy(place)
    kind, mark = F.substring_index(F.col(tag), "-", -1), F.substring(tag, 1, 1)
    rows = df.select(key, F.col(place).alias("p"), mark.alias("m"), kind.alias("k"))
    goes_on = (F.col("m") == "I") & (F.lag("k").over(w) == F.col("k")) & F.lag("m").over(w).isin("B", "I")
    rows = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    rows = rows.withColumn("island", F.sum((~F.col("goes_on")).cast("int")).over(w))
    spans = rows.groupBy(key, "island").agg(F.min(F.struct("p", "m", "k")).alias("head"), (F.max("p") + 1).alias("stop")).where("head.m = 'B'")
    return spans.select(key, F.col("head.k").alias("kind"), F.col("head.p").alias("start"), "stop")


def span_f1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two span tables."""
    cols = truth.columns
    both = truth.distinct().withColumn("t", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), cols, "full")
    c = both.agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return c.select("tp", "fp", "fn", fn.ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"), fn.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0).alias("recall"), fn.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0).alias("f1"))


def masked_tokens(df: DataFrame, key: str, tokens: str, seed: int = 0, rate: float = 0.15) -> DataFrame:
    """key, p, tok, action: keep, or of the chosen share 80 % mask, 10 % random, 10 % same. Draws hash (seed, key, place)."""
    u = lambda s: fn.hashed_uniform(F.lit(seed + s), F.col(key), F.col("p"))
    rows = df.select(key, F.posexplode(tokens).alias("p", "tok"))
    return rows.withColumn("action", F.when(u(0) >= rate, "keep").when(u(1) < 0.8, "mask").when(u(1) < 0.9, "random").otherwise("same"))


def next_token_targets(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, p, tok, target: causal examples, the last place without one."""
    return df.select(key, F.posexplode(F.zip_with(tokens, F.concat(F.slice(F.col(tokens), F.lit(2), F.greatest(F.size(tokens), F.lit(1))), F.array(F.lit(None).cast("string"))), lambda a, b: F.struct(a.alias("tok"), b.alias("target")))).alias("p", "x")).select(key, "p", "x.tok", "x.target")


def span_corruption(df: DataFrame, key: str, tokens: str, rate: float = 0.15, length: int = 3) -> DataFrame:
    """key, n_spans, n_masked, source, target: runs of `length` places are dropped by the hash of (key, run); a sentinel <i> stands for each in the
    source, and before its tokens in the target."""
    n = F.floor((F.size(tokens) + length - 1) / length).cast("int")
    runs = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.select(key, F.col(tokens).alias("__t"), F.filter(runs, lambda r: fn.hashed_uniform(F.lit("span"), F.col(key), r) < rate).alias("__m"), runs.alias("__r"))
    body = lambda r: F.array_join(F.slice("__t", r * length + 1, length), " ")
    mark = lambda r: F.concat(F.lit("<"), (F.array_position("__m", r) - 1).cast("string"), F.lit(">"))
    source = F.array_join(F.transform("__r", lambda r: F.when(F.array_contains("__m", r), mark(r)).otherwise(body(r))), " ")
    target = F.array_join(F.transform("__m", lambda r: F.concat(mark(r), F.lit(" "), body(r))), " ")
    masked = F.aggregate("__m", F.lit(0), lambda a, r: a + F.size(F.slice("__t", r * length + 1, length)))
    return rows.select(key, F.size("__m").alias("n_spans"), masked.alias("n_masked"), source.alias("source"), target.alias("target"))


def word_pair_weights(counts: DataFrame, most: float = 10.0, power: float = 0.75) -> DataFrame:
    """Adds weight (min((n / most) ** power, 1)) and log_n to co-occurrence counts: the rows that a factorisation of log counts is fitted to."""
    return counts.withColumn("weight", F.least(F.pow(F.col("n") / most, F.lit(power)), F.lit(1.0))).withColumn("log_n", F.ln(F.col("n").cast("double")))
