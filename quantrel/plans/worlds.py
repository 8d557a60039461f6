"""Queries of vision, decision processes, decoding and generated grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantrel.operators import decision as dec
from quantrel.operators import vision as vis
from quantrel.operators.metrics import pinned
from quantrel.sources import gridworld, table

from . import unrolled
from .registry import query

BOXES = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 3, 20.0, 20.0, 30.0, 30.0, 0.7), (2, 4, 5.0, 5.0, 15.0, 15.0, 0.95), (2, 5, 5.0, 10.0, 15.0, 20.0, 0.6)]
VALUES = "(SELECT * FROM (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, {', '.join(f'{x}::DOUBLE' for x in r)})" for a, b, *r in BOXES) + ") t(img, k, x1, y1, x2, y2, s))"


def boxes(spark):
    return spark.createDataFrame(BOXES, "img long, k long, x1 double, y1 double, x2 double, y2 double, s double")


@query(f"""WITH o AS (SELECT a.k AS a, b.k AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM {VALUES} a JOIN {VALUES} b ON a.img = b.img AND a.k < b.k)
SELECT a, b, round(i / greatest(u - i, 1e-12), 6) AS iou FROM o""")
def iou_pairs(spark, d):
    side = lambda s: boxes(spark).select(F.col("img").alias("img"), *(F.col(c).alias(f"{s}{c}") for c in ("k", "x1", "y1", "x2", "y2")))
    return pinned(side("a").join(side("b"), "img").where("ak < bk").select(F.col("ak").alias("a"), F.col("bk").alias("b"), vis.iou("a", "b").alias("iou")))


PLACED = """(SELECT label AS img, vec_id AS k, x - w AS x1, y - h AS y1, x + w AS x2, y + h AS y2, s FROM (SELECT label, vec_id, 20 * embedding[1]::DOUBLE AS x, 20 * embedding[2]::DOUBLE AS y, 3 + 4 * abs(embedding[3]::DOUBLE) AS w, 3 + 4 * abs(embedding[4]::DOUBLE) AS h, embedding[5]::DOUBLE AS s FROM embeddings))"""


def placed(spark, d):
    """A box for each vector, its label the image."""
    e = lambda i: F.col("embedding")[i].cast("double")
    x, y, w, h = 20 * e(0), 20 * e(1), 3 + 4 * F.abs(e(2)), 3 + 4 * F.abs(e(3))
    return table(spark, d, "embeddings").select(F.col("label").alias("img"), F.col("vec_id").alias("k"), (x - w).alias("x1"), (y - h).alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), e(4).alias("s"))


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY s DESC, x1, y1) AS r FROM {PLACED}),
g AS (SELECT img, r, k, true AS kept, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS own FROM b WHERE r = 1 UNION ALL
SELECT img, r, k, kept, CASE WHEN kept THEN list_append(own, box) ELSE own END FROM (SELECT b.img, b.r, b.k, own, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}} AS box, len(list_filter(own, lambda o:
 greatest(least(o.x2, b.x2) - greatest(o.x1, b.x1), 0) * greatest(least(o.y2, b.y2) - greatest(o.y1, b.y1), 0) > 0.5 * greatest((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(o.x2, b.x2) - greatest(o.x1, b.x1), 0) * greatest(least(o.y2, b.y2) - greatest(o.y1, b.y1), 0), 1e-12))) = 0 AS kept
 FROM g JOIN b ON b.img = g.img AND b.r = g.r + 1)) SELECT img, k FROM g WHERE kept""")
def box_suppression(spark, d):
    return vis.suppress(placed(spark, d), "img", "s", 0.5).select("img", "k")


@query(f"SELECT k, round(((x1 + x2) / 2 - 8) / 8, 6) AS tx, round(((y1 + y2) / 2 - 8) / 8, 6) AS ty, round(ln((x2 - x1) / 8), 6) AS sx, round(ln((y2 - y1) / 8), 6) AS sy, round(x1, 6) AS x1, round(x2, 6) AS x2, round(y1, 6) AS y1, round(y2, 6) AS y2 FROM {VALUES}")
def anchor_offsets(spark, d):
    b = boxes(spark).select("k", *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")), F.lit(4.0).alias("ax1"), F.lit(4.0).alias("ay1"), F.lit(12.0).alias("ax2"), F.lit(12.0).alias("ay2"))
    e = b.select("*", *vis.encode_boxes("b", "a"))
    return pinned(e.select("k", "tx", "ty", "sx", "sy", *vis.decode_boxes("a")))


@query(f"""WITH p AS (SELECT * FROM {PLACED}), t AS (SELECT img, k AS t, x1 + 1 AS x1, y1 + 1 AS y1, x2 + 1 AS x2, y2 + 1 AS y2 FROM {PLACED} WHERE k % 3 = 0), o AS (SELECT p.k, p.s, t.t, greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS u FROM p LEFT JOIN t USING (img)),
b AS (SELECT k, s, CASE WHEN i / greatest(u - i, 1e-12) >= 0.5 THEN t END AS t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i / greatest(u - i, 1e-12) DESC, t) AS r FROM o) WHERE r = 1), f AS (SELECT k, s, (t IS NOT NULL AND row_number() OVER (PARTITION BY t ORDER BY s DESC, k) = 1)::INT AS tp FROM b),
c AS (SELECT *, sum(tp) OVER (ORDER BY s DESC, k ROWS UNBOUNDED PRECEDING) / row_number() OVER (ORDER BY s DESC, k) AS pr, row_number() OVER (ORDER BY s DESC, k) AS rank FROM f), e AS (SELECT tp, max(pr) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM c) SELECT round(sum(tp * e) / (SELECT count(*) FROM t), 6) AS average_precision FROM e""")
def detection_precision(spark, d):
    p = placed(spark, d)
    truth = p.where(F.col("k") % 3 == 0).select("img", F.col("k").alias("t"), *((F.col(c) + 1).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return pinned(vis.detection_precision(p, truth, "img", "s", "k", "t"))


@query("SELECT round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 6) AS iou, round(2 * count(*) FILTER (a AND b) / (count(*) FILTER (a) + count(*) FILTER (b)), 6) AS dice FROM (SELECT x BETWEEN 2 AND 13 AND y BETWEEN 2 AND 13 AS a, x BETWEEN 4 AND 15 AND y BETWEEN 4 AND 15 AS b FROM range(20) t(x), range(20) u(y))")
def mask_overlap(spark, d):
    g = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    inside = lambda a, b: F.col("x").between(a, b) & F.col("y").between(a, b)
    return pinned(vis.mask_overlap(g, inside(2, 13), inside(4, 15)))


PIXELS = "(SELECT vec_id AS n, 0 AS c, (p - 1) // 8 AS h, (p - 1) % 8 AS w, embedding[p]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS p FROM embeddings))"
SOBEL = [(0, 0, i, j, float(v)) for i, row in enumerate(((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))) for j, v in enumerate(row)]


def pixels(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.lit(0).alias("c"), F.posexplode("embedding").alias("p", "x")).select("n", "c", F.floor(F.col("p") / 8).alias("h"), (F.col("p") % 8).cast("long").alias("w"), F.col("x").cast("double").alias("v"))


@query(f"""WITH k AS (SELECT * FROM (VALUES {', '.join(str((i, j, v)) for _, _, i, j, v in SOBEL)}) t(di, dj, wt)), m AS (SELECT n, h + 1 - di AS i, w + 1 - dj AS j, v * wt::DOUBLE AS v FROM {PIXELS}, k)
SELECT n, 0 AS o, i::BIGINT AS i, j::BIGINT AS j, round(sum(v), 6) + 0 AS v FROM m WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 GROUP BY ALL""")
def sobel_convolution(spark, d):
    w = spark.createDataFrame(SOBEL, "o int, c int, di int, dj int, wt double")
    r = vis.convolve(pixels(spark, d), w, 8, 8, 3, pad=1)
    return r.select("n", "o", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"SELECT n, (h // 2)::BIGINT AS i, (w // 2)::BIGINT AS j, round(max(v), 6) AS top, round(avg(v), 6) AS mean FROM {PIXELS} GROUP BY ALL")
def pooling(spark, d):
    p = pixels(spark, d)
    return pinned(vis.pool(p, 2).withColumnRenamed("v", "top").join(vis.pool(p, 2, "avg").withColumnRenamed("v", "mean"), ["n", "c", "i", "j"]).drop("c"))


GRID = """t AS (SELECT s, a, CASE WHEN s = 15 THEN s WHEN a = 0 THEN greatest(s // 4 - 1, 0) * 4 + s % 4 WHEN a = 1 THEN least(s // 4 + 1, 3) * 4 + s % 4 WHEN a = 2 THEN s // 4 * 4 + greatest(s % 4 - 1, 0) ELSE s // 4 * 4 + least(s % 4 + 1, 3) END AS s2, CASE WHEN s = 15 THEN 0 ELSE -1 END AS r FROM range(16) x(s), range(4) y(a)), v0 AS (SELECT s, 0::DOUBLE AS v FROM range(16) x(s))"""


@query("WITH " + GRID + "".join(f", v{i} AS (SELECT t.s, max(r + 0.9::DOUBLE * v) AS v FROM t JOIN v{i - 1} v ON v.s = t.s2 GROUP BY t.s)" for i in range(1, 6)) + " SELECT s, round(v, 6) AS v FROM v5")
def gridworld_sweeps(spark, d):
    return pinned(dec.value_sweeps(gridworld(spark), 0.9, 5))


@query("WITH " + GRID + "".join(f", v{i} AS (SELECT t.s, avg(r + 0.9::DOUBLE * v) AS v FROM t JOIN v{i - 1} v ON v.s = t.s2 GROUP BY t.s)" for i in range(1, 5)) + " SELECT s, round(v, 6) AS v FROM v4")
def uniform_policy_values(spark, d):
    g = gridworld(spark)
    return pinned(dec.policy_evaluation(g, g.select("s", "a").withColumn("pi", F.lit(0.25)), 0.9, 4))


@query()
def policy_iteration(spark, d):
    r, steps = dec.policy_iteration(gridworld(spark), 0.9)
    return r.withColumn("steps", F.lit(steps))


@query("""WITH e AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), n AS (SELECT event_type, next, count(*) AS n FROM e WHERE next IS NOT NULL GROUP BY ALL)
SELECT event_type, next, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS p FROM n""")
def event_transition_matrix(spark, d):
    return pinned(dec.transition_matrix(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type"))


LOGITS = "(SELECT lang AS g, source AS tok, ln(count(*)) AS z FROM documents GROUP BY ALL)"


def logits(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("g"), F.col("source").alias("tok")).agg(F.ln(F.count(F.lit(1))).alias("z"))


@query(f"SELECT g, tok, round(exp(z / 0.7) / sum(exp(z / 0.7)) OVER (PARTITION BY g), 6) AS share FROM {LOGITS}")
def temperature_shares(spark, d):
    return pinned(dec.token_shares(logits(spark, d), "g", F.col("z"), 0.7).select("g", "tok", "share"))


SHARES = f"(SELECT g, tok, round(exp(z) / sum(exp(z)) OVER (PARTITION BY g), 9) AS s FROM {LOGITS})"


def shares(spark, d):
    return dec.token_shares(logits(spark, d), "g", F.col("z")).select("g", "tok", F.round("share", 9).alias("share"))


@query(f"WITH k AS (SELECT * FROM {SHARES} QUALIFY row_number() OVER (PARTITION BY g ORDER BY s DESC, tok) <= 5) SELECT g, tok, round(s / sum(s) OVER (PARTITION BY g), 6) AS share FROM k")
def top_k_shares(spark, d):
    return pinned(dec.top_k_shares(shares(spark, d), "g", "tok", 5).select("g", "tok", "share"))


@query(f"WITH k AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY g ORDER BY s DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {SHARES}), f AS (SELECT * FROM k WHERE before < 0.5::DOUBLE) SELECT g, tok, round(s / sum(s) OVER (PARTITION BY g), 6) AS share FROM f")
def top_p_shares(spark, d):
    return pinned(dec.top_p_shares(shares(spark, d), "g", "tok", 0.5).select("g", "tok", "share"))


STEPS = [("", "A", 0.5), ("", "B", 0.4), ("", "C", 0.1), ("A", "C", 0.5), ("A", "B", 0.3), ("A", "A", 0.2), ("B", "C", 0.9), ("B", "A", 0.1), ("C", "A", 0.8), ("C", "B", 0.2)]
STEP_ROWS = "(SELECT prev, tok, ln(p::DOUBLE) AS lp FROM (VALUES " + ", ".join(str(s) for s in STEPS) + ") t(prev, tok, p))"


@query(f"""WITH s AS (SELECT * FROM {STEP_ROWS}), b1 AS (SELECT tok AS text, tok AS last, lp AS score FROM s WHERE prev = '' ORDER BY score DESC, text LIMIT 2), b2 AS (SELECT text || tok AS text, tok AS last, score + lp AS score FROM b1 JOIN s ON last = prev ORDER BY 3 DESC, 1 LIMIT 2),
b3 AS (SELECT text || tok AS text, score + lp AS score FROM b2 JOIN s ON last = prev ORDER BY 2 DESC, 1 LIMIT 2) SELECT text, round(exp(score), 6) AS p FROM b3""")
def beam_search(spark, d):
    s = spark.createDataFrame(STEPS, "prev string, tok string, p double").select("prev", "tok", F.ln("p").alias("lp"))
    return dec.beam_search(s, 2, 3).select("text", F.round(F.exp("score"), 6).alias("p"))


@query("""WITH g AS (SELECT vec_id, p - 1 AS expert, embedding[p]::DOUBLE * 10 AS z FROM (SELECT *, unnest(range(1, 9)) AS p FROM embeddings)), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, expert) <= 2)
SELECT vec_id, expert::INT AS expert, round(exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id), 6) AS weight FROM k""")
def expert_routing(spark, d):
    g = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("expert", "x")).withColumn("z", F.col("x").cast("double") * 10)
    return pinned(dec.route_top(g, "vec_id", "expert", F.col("z")))


@query("""WITH g AS (SELECT pow(10, 6 + i * (7.0::DOUBLE / 5999)) AS n FROM range(6000) t(i)), l AS (SELECT n, 1e21::DOUBLE / 6 / n AS d, 1.69 + 406.4 / pow(n, 0.34) + 410.7 / pow(1e21::DOUBLE / 6 / n, 0.28) AS loss FROM g)
SELECT round(log10(n), 6) AS log_n, round(log10(d), 6) AS log_d, round(loss, 6) AS loss FROM l ORDER BY l.loss LIMIT 1""")
def compute_optimal(spark, d):
    return dec.compute_optimal(spark, 1e21).select(F.round(F.log10("n"), 6).alias("log_n"), F.round(F.log10("d"), 6).alias("log_d"), F.round("loss", 6).alias("loss"))


@query("SELECT round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem")
def power_law(spark, d):
    return pinned(dec.power_law(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("WITH b AS (SELECT t, 1e-4 + t * ((0.15 - 1e-4) / 39)::DOUBLE AS beta FROM range(40) x(t)), a AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS ab FROM b) SELECT t, round(beta, 6) AS beta, round(ab, 6) AS alpha_bar, round(ab / (1 - ab), 4) AS snr FROM a")
def diffusion_schedule(spark, d):
    return dec.diffusion_schedule(spark).select("t", F.round("beta", 6).alias("beta"), F.round("alpha_bar", 6).alias("alpha_bar"), F.round("snr", 4).alias("snr"))


@query(unrolled.strengths(10))
def bradley_terry(spark, d):
    o = table(spark, d, "orders")
    from pyspark.sql import Window

    p = o.withColumn("other", F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumn("before", F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    p = p.where("other is not null and other <> o_orderpriority")
    up = F.col("o_totalprice") > F.col("before")
    return pinned(dec.bradley_terry(p.select(F.when(up, F.col("o_orderpriority")).otherwise(F.col("other")).alias("w"), F.when(up, F.col("other")).otherwise(F.col("o_orderpriority")).alias("l")), "w", "l", 10))
