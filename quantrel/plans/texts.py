"""Queries over text, baskets and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantrel import functions as fn
from quantrel.operators import rules, text, trees
from quantrel.operators.metrics import pinned
from quantrel.sources import table

from . import unrolled
from .foundations import uniform
from .registry import query

W = "list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda x: x <> '')"
DOCS = f"(SELECT doc_id, {W} AS w FROM documents)"
TF = f"(SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS tok FROM {DOCS}) GROUP BY ALL)"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("w"))


@query(f"SELECT tok, sum(tf)::BIGINT AS n, count(*) AS docs FROM {TF} GROUP BY tok")
def token_counts(spark, d):
    tf = text.counted(docs(spark, d), "doc_id", F.col("w"))
    return tf.groupBy("tok").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(f"""WITH v AS (SELECT tok, min((doc_id, p)) AS f FROM (SELECT doc_id, w[p] AS tok, p FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM {DOCS})) GROUP BY tok) SELECT tok, f[1] AS doc_id, (f[2] - 1)::INT AS p FROM v""".replace("min((doc_id, p)) AS f", "min([doc_id, p]) AS f"))
def vocabulary_order(spark, d):
    return text.vocabulary(docs(spark, d), "doc_id", F.col("w")).select("tok", "first_seen.doc_id", "first_seen.p")


@query(f"""WITH t AS (SELECT * FROM {TF}), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
w AS (SELECT doc_id, tok, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN f USING (tok), n), u AS (SELECT doc_id, tok, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 1e-12) AS weight FROM w)
SELECT doc_id, tok, round(weight, 6) AS weight FROM u""")
def tfidf_weights(spark, d):
    t = docs(spark, d)
    return pinned(text.tfidf(text.counted(t, "doc_id", F.col("w")), "doc_id", t.count()))


@query(f"SELECT g AS tok, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM {DOCS} WHERE len(w) > 1) GROUP BY g")
def bigram_counts(spark, d):
    return docs(spark, d).select(F.explode(text.ngrams(F.col("w"), 2)).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT doc_id, p, w[p] AS tok FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM {DOCS})) SELECT a.tok AS centre, b.tok AS context, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p - 2 AND a.p + 2 AND a.p <> b.p GROUP BY ALL""")
def cooccurrence(spark, d):
    return text.cooccurrence(docs(spark, d), F.col("w"))


def word_freq(spark, d):
    return text.counted(docs(spark, d), "doc_id", F.col("w")).groupBy("tok").agg(F.sum("tf").alias("freq"))


@query(f"""WITH f AS (SELECT tok, sum(tf) AS freq FROM {TF} GROUP BY tok), s AS (SELECT freq, list_append(string_split(tok, ''), '</w>') AS s FROM f), p AS (SELECT s[i] AS a, s[i + 1] AS b, freq FROM (SELECT *, unnest(range(1, len(s))) AS i FROM s))
SELECT a, b, sum(freq)::BIGINT AS n FROM p GROUP BY ALL""")
def bpe_pair_counts(spark, d):
    rows = word_freq(spark, d).select(F.concat(F.array_remove(F.split("tok", ""), ""), F.array(F.lit("</w>"))).alias("s"), "freq")
    return text.symbol_counts(rows, "s", "freq")


@query()
def bpe_merges(spark, d):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(text.learn_merges(word_freq(spark, d), "tok", "freq", 8))], "step int, a string, b string")


TURNS = "(SELECT conv_id, turn, text AS hyp, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS ref FROM conversations)"
PAIRS = f"(SELECT conv_id * 10000 + turn AS id, ref, hyp FROM {TURNS} WHERE ref IS NOT NULL)"


def turns(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("ref", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    return c.where("ref is not null").select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), "ref", F.col("text").alias("hyp"))


def _words(c):
    return f"list_filter(string_split_regex(trim(lower({c})), '\\s+'), lambda x: x <> '')"


def _grams(c, n):
    return f"(CASE WHEN len({_words(c)}) >= {n} THEN list_transform(range(1, len({_words(c)}) - {n} + 2), lambda i: array_to_string(({_words(c)})[i:i + {n} - 1], ' ')) ELSE [] END)"


def _overlap(n):
    side = lambda c, k: f"(SELECT id, g, count(*) AS {k} FROM (SELECT id, unnest({_grams(c, n)}) AS g FROM {PAIRS}) GROUP BY ALL)"
    return f"(SELECT id, sum(least(coalesce(ca, 0), coalesce(cb, 0))) AS both, sum(coalesce(ca, 0)) AS na, sum(coalesce(cb, 0)) AS nb FROM {side('ref', 'ca')} FULL JOIN {side('hyp', 'cb')} USING (id, g) GROUP BY id)"


@query(f"SELECT a.id, round(coalesce(a.both / nullif(a.na, 0), 0), 6) AS rouge_1, round(coalesce(b.both / nullif(b.na, 0), 0), 6) AS rouge_2 FROM {_overlap(1)} a LEFT JOIN {_overlap(2)} b USING (id)")
def rouge_scores(spark, d):
    t = turns(spark, d)
    return pinned(text.rouge_n(t, "id", "ref", "hyp", 1).join(text.rouge_n(t, "id", "ref", "hyp", 2), "id", "left").na.fill(0.0))


@query(f"""WITH l AS (SELECT id, len({_words('ref')}) AS rl, len({_words('hyp')}) AS hl FROM {PAIRS}), p AS (SELECT l.*, {', '.join(f'coalesce(o{n}.both / nullif(o{n}.nb, 0), 0) AS p{n}' for n in range(1, 5))} FROM l {' '.join(f'LEFT JOIN {_overlap(n)} o{n} ON o{n}.id = l.id' for n in range(1, 5))}),
b AS (SELECT *, CASE WHEN hl = 0 THEN 0 WHEN hl >= rl THEN 1 ELSE exp(1 - rl / hl) END AS brevity FROM p)
SELECT id, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, round(brevity, 6) AS brevity, round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN brevity * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 6) AS bleu FROM b""")
def bleu_scores(spark, d):
    return pinned(text.bleu(turns(spark, d), "id", "ref", "hyp").drop("rl", "hl"))


@query(unrolled.common_subsequence(PAIRS, _words("ref"), _words("hyp")))
def rouge_l_scores(spark, d):
    return pinned(turns(spark, d).select("id", text.rouge_l(F.col("ref"), F.col("hyp")).alias("rouge_l")))


def _norm(c):
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[.,]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT id, {_norm('hyp')} AS p, {_norm('ref')} AS g FROM {PAIRS}), s AS (SELECT id, w, count(*) AS ca FROM (SELECT id, unnest({_words('p')}) AS w FROM n) GROUP BY ALL), t AS (SELECT id, w, count(*) AS cb FROM (SELECT id, unnest({_words('g')}) AS w FROM n) GROUP BY ALL),
o AS (SELECT id, sum(least(coalesce(ca, 0), coalesce(cb, 0))) AS shared, sum(coalesce(ca, 0)) + sum(coalesce(cb, 0)) AS total FROM s FULL JOIN t USING (id, w) GROUP BY id)
SELECT id, (p = g)::INT AS exact_match, round(coalesce(2 * shared / nullif(total, 0), 0), 6) AS f1 FROM n LEFT JOIN o USING (id)""")
def answer_scores(spark, d):
    return pinned(text.answer_scores(turns(spark, d), "id", "hyp", "ref"))


CHARS = "list_distinct(list_transform(range(1, length('<' || {0} || '>') - 1), lambda i: substring('<' || {0} || '>', i::BIGINT, 3)))"


@query(f"""WITH p AS (SELECT p_partkey, p_name AS a, lower(p_type) AS b FROM part), g AS (SELECT p_partkey, {CHARS.format('a')} AS ga, {CHARS.format('b')} AS gb FROM p)
SELECT p_partkey, round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 6) AS jaccard FROM g""")
def char3_jaccard(spark, d):
    return pinned(table(spark, d, "part").select("p_partkey", text.jaccard(text.char_ngrams(F.col("p_name")), text.char_ngrams(F.lower("p_type"))).alias("jaccard")))


TAGGED = f"""(SELECT user_id, p, CASE WHEN u < 0.3 THEN 'O' WHEN u < 0.6 THEN 'B-' || k ELSE 'I-' || k END AS truth, CASE WHEN v < 0.2 OR u < 0.3 THEN 'O' WHEN u < 0.6 THEN 'B-' || k ELSE 'I-' || k END AS predicted
FROM (SELECT user_id, p, CASE WHEN p // 4 % 2 = 0 THEN 'PER' ELSE 'LOC' END AS k, {uniform("'u'", 'event_id')} AS u, {uniform("'v'", 'event_id')} AS v FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)))"""


@query(f"""WITH t AS (SELECT 't' AS s, user_id, p, truth AS tag FROM {TAGGED} UNION ALL SELECT 'p', user_id, p, predicted FROM {TAGGED}), m AS (SELECT s, user_id, p, tag[1] AS m, split_part(tag, '-', -1) AS k, lag(tag[1]) OVER w AS lm, lag(split_part(tag, '-', -1)) OVER w AS lk FROM t WINDOW w AS (PARTITION BY s, user_id ORDER BY p)),
i AS (SELECT *, sum(CASE WHEN m = 'I' AND lk = k AND lm IN ('B', 'I') THEN 0 ELSE 1 END) OVER (PARTITION BY s, user_id ORDER BY p) AS island FROM m), sp AS (SELECT s, user_id, min(p) AS a, max(p) AS z, arg_min(k, p) AS k FROM i GROUP BY s, user_id, island HAVING arg_min(m, p) = 'B'),
c AS (SELECT count(*) FILTER (x.s IS NOT NULL AND y.s IS NOT NULL) AS tp, count(*) FILTER (x.s IS NULL) AS fp, count(*) FILTER (y.s IS NULL) AS fn FROM (SELECT * FROM sp WHERE s = 't') x FULL JOIN (SELECT * FROM sp WHERE s = 'p') y ON x.user_id = y.user_id AND x.a = y.a AND x.z = y.z AND x.k = y.k)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def entity_f1(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("p"))
    k, u, v = F.when(F.floor(F.col("p") / 4) % 2 == 0, "PER").otherwise("LOC"), fn.hashed_uniform(F.lit("u"), F.col("event_id")), fn.hashed_uniform(F.lit("v"), F.col("event_id"))
    truth = F.when(u < 0.3, "O").when(u < 0.6, F.concat(F.lit("B-"), k)).otherwise(F.concat(F.lit("I-"), k))
    rows = e.select("user_id", "p", truth.alias("truth"), F.when(v < 0.2, "O").otherwise(truth).alias("predicted"))
    return pinned(text.span_f1(text.spans_from_bio(rows, "user_id", "p", "truth"), text.spans_from_bio(rows, "user_id", "p", "predicted")))


@query(f"""WITH t AS (SELECT doc_id, unnest(range(0, len(w))) AS p FROM {DOCS}), u AS (SELECT {uniform('0', 'doc_id', 'p')} AS a, {uniform('1', 'doc_id', 'p')} AS b FROM t)
SELECT CASE WHEN a >= 0.15 THEN 'keep' WHEN b < 0.8 THEN 'mask' WHEN b < 0.9 THEN 'random' ELSE 'same' END AS action, count(*) AS n FROM u GROUP BY 1""")
def masked_tokens(spark, d):
    return text.masked_tokens(docs(spark, d), "doc_id", "w").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, (p - 1)::INT AS p, w[p] AS tok, w[p + 1] AS target FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM {DOCS})")
def next_token_targets(spark, d):
    return text.next_token_targets(docs(spark, d), "doc_id", "w")


BASKETS = "(SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"
SETS = f"""WITH x AS (SELECT b, list_sort(list(i)) AS l FROM {BASKETS} GROUP BY b), n AS (SELECT count(*)::DOUBLE AS n FROM x), m AS (SELECT l, unnest(range(1, (1 << len(l))::BIGINT)) AS mask FROM x),
s AS (SELECT list_filter(l, lambda v, k: (mask >> (k - 1)) & 1 = 1) AS items, count(*) AS c FROM m GROUP BY 1), f AS (SELECT items, len(items)::INT AS size, c AS n, c / n.n AS support FROM s, n WHERE c >= {{m}} * n.n - 1e-9)"""


def sets(spark, d, support):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rules.frequent_itemsets(j, "l_orderkey", "p_brand", support)


@query(SETS.replace("{m}", "0.002") + " SELECT array_to_string(items, ',') AS items, size, n, round(support, 6) AS support FROM f")
def frequent_itemsets(spark, d):
    return pinned(sets(spark, d, 0.002).withColumn("items", F.array_join("items", ",")))


@query(SETS.replace("{m}", "0.01") + """, r AS (SELECT a.items AS x, c.items AS y, f.support, f.support / a.support AS confidence, f.support / a.support / c.support AS lift FROM f JOIN f a ON len(list_intersect(f.items, a.items)) = len(a.items) AND len(a.items) < len(f.items)
JOIN f c ON len(list_intersect(f.items, c.items)) = len(c.items) AND len(list_intersect(a.items, c.items)) = 0 AND len(a.items) + len(c.items) = len(f.items) WHERE f.size > 1)
SELECT array_to_string(x, ',') AS antecedent, array_to_string(y, ',') AS consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r WHERE confidence >= 0.1 - 1e-12""")
def rules_lift(spark, d):
    r = rules.association_rules(sets(spark, d, 0.01), 0.1)
    return pinned(r.withColumn("antecedent", F.array_join("antecedent", ",")).withColumn("consequent", F.array_join("consequent", ",")))


FEATURES = ["l_quantity", "l_discount", "l_tax"]


def items(spark, d):
    return table(spark, d, "lineitem").select(*FEATURES, "l_returnflag", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("s"), "l_extendedprice", F.lit(1.0).alias("w"), "l_orderkey")


MELT = "(" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, l_returnflag, l_extendedprice AS e FROM lineitem" for f in FEATURES) + ")"


@query(f"""WITH c AS (SELECT feature, value, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM {MELT} GROUP BY ALL),
s AS (SELECT feature, (value + lead(value) OVER o) / 2 AS threshold, sum(a) OVER o AS la, sum(n) OVER o AS ln_, sum(r) OVER o AS lr, sum(a) OVER t AS ta, sum(n) OVER t AS tn, sum(r) OVER t AS tr FROM c WINDOW o AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
g AS (SELECT feature, threshold, 1 - (ta*ta + tn*tn + tr*tr)::DOUBLE / pow(ta+tn+tr, 2) - ((la+ln_+lr) * (1 - (la*la + ln_*ln_ + lr*lr)::DOUBLE / pow(la+ln_+lr, 2)) + (ta+tn+tr-la-ln_-lr) * (1 - (pow(ta-la, 2) + pow(tn-ln_, 2) + pow(tr-lr, 2)) / pow(ta+tn+tr-la-ln_-lr, 2))) / (ta+tn+tr) AS gain FROM s WHERE threshold IS NOT NULL)
SELECT feature, round(threshold, 6) AS threshold, round(gain, 8) AS gain FROM g""")
def gini_splits(spark, d):
    flags = ["A", "N", "R"]
    counts = trees.value_counts(items(spark, d), FEATURES, {f"c{i}": (F.col("l_returnflag") == f).cast("long") for i, f in enumerate(flags)})
    s = trees.split_table(counts, ["c0", "c1", "c2"]).withColumn("gain", trees.gini_gain(3))
    return s.select("feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 8).alias("gain"))


@query(f"""WITH c AS (SELECT feature, value, sum(e - 50000) AS g, count(*)::DOUBLE AS h FROM {MELT} GROUP BY ALL), s AS (SELECT feature, (value + lead(value) OVER o) / 2 AS threshold, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER t AS g, sum(h) OVER t AS h FROM c WINDOW o AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature))
SELECT feature, round(threshold, 6) AS threshold, round(0.5 * (gl*gl/(hl+1) + (g-gl)*(g-gl)/(h-hl+1) - g*g/(h+1)) / 1000000, 3) AS gain FROM s WHERE threshold IS NOT NULL""")
def second_order_gains(spark, d):
    counts = trees.value_counts(items(spark, d), FEATURES, {"g": F.col("l_extendedprice") - 50000, "h": F.lit(1.0)})
    s = trees.split_table(counts, ["g", "h"])
    return s.select("feature", F.round("threshold", 6).alias("threshold"), F.round(trees.second_order_gain() / 1000000, 3).alias("gain"))


@query(f"""WITH c AS (SELECT feature, value, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS p, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS m FROM {MELT} GROUP BY ALL), s AS (SELECT feature, (value + lead(value) OVER o) / 2 AS threshold, sum(p) OVER o AS lp, sum(m) OVER o AS lm, sum(p) OVER t AS tp, sum(m) OVER t AS tm FROM c WINDOW o AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
e AS (SELECT feature, threshold, (lp + tm - lm) / (tp + tm) AS left_minus FROM s WHERE threshold IS NOT NULL), r AS (SELECT round(least(left_minus, 1 - left_minus), 12) AS error, feature, threshold, CASE WHEN left_minus <= 1 - left_minus THEN -1 ELSE 1 END AS polarity FROM e)
SELECT feature, round(threshold, 6) AS threshold, polarity, round(error, 8) AS error FROM r ORDER BY r.error, feature, r.threshold LIMIT 1""")
def weighted_stump(spark, d):
    s = trees.weighted_stump(items(spark, d), FEATURES, "s", "w")
    return s.select("feature", F.round("threshold", 6).alias("threshold"), "polarity", F.round("error", 8).alias("error"))


@query(unrolled.tree(FEATURES, {f"c{i}": f"(l_returnflag = '{f}')::BIGINT" for i, f in enumerate("ANR")}, unrolled.gini(3), "CASE WHEN sum(c0) >= greatest(sum(c1), sum(c2)) THEN 'A' WHEN sum(c1) >= sum(c2) THEN 'N' ELSE 'R' END", 3))
def classification_tree(spark, d):
    rows = items(spark, d)
    t = trees.classification_tree(rows, FEATURES, "l_returnflag", ["A", "N", "R"], depth=3)
    return rows.groupBy(t.column(what="node").alias("node"), t.column().alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(unrolled.tree(FEATURES, {"n": "1", "s": "l_extendedprice"}, unrolled.VARIANCE, "round(avg(s), 4)", 3, ", round(avg(s), 4) AS mean"))
def regression_tree(spark, d):
    rows = items(spark, d)
    t = trees.regression_tree(rows, FEATURES, "l_extendedprice", depth=3)
    return rows.groupBy(t.column(what="node").alias("node"), F.round(t.column(), 4).alias("predicted")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query()
def random_forest(spark, d):
    rows = items(spark, d)
    f = trees.forest(rows, "l_orderkey", FEATURES, "l_returnflag", ["A", "N", "R"], trees=3, depth=2)
    return rows.groupBy("l_returnflag", trees.majority(f, ["A", "N", "R"]).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query()
def gradient_boosting(spark, d):
    rows = items(spark, d)
    t = trees.boosted(rows, FEATURES, "l_extendedprice", rounds=3, depth=2)
    return rows.agg(F.avg(F.pow(F.col("l_extendedprice") - trees.margin(t, 0.3), F.lit(2))).alias("mse"), F.var_pop("l_extendedprice").alias("variance"))


@query()
def adaboost_margins(spark, d):
    rows = items(spark, d)
    m = trees.adaboost(rows, FEATURES, "s", rounds=3)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(m)], "round int, alpha double, feature string, threshold double, polarity int")
