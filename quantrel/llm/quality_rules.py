"""Operator 9: quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule's cost (seconds on a sample, net of the job's own) and selectivity (share of the sample that it rejects) are
measured first; the rules then run in the order of rejection per cost, and a document meets
only the rules up to the first that rejects it. The order changes the time, never the verdict.

Defined cases: null and empty texts have no words, so the word-count rule rejects them. A text of
any length is judged whole. Repeated rows are judged row by row. An empty table gives an empty
result; the rules then run as declared. Extra columns, whatever their names, pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, let, materialise, new_path, reserve, split_words, table, upto

#: Rows of the sample on which cost and selectivity are estimated (it steers the order only).
SAMPLE_ROWS = 2000
REPEATS = 3
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def count_chars(text: Column, chars: str) -> Column:
    """Characters of `text` that are in the class `chars`."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, the first included.

    Windows are compared by 64-bit hash; a text without a repeated hash costs no sort.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        starts = let(ordered, lambda s: F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"]))
        return let(F.sort_array(starts), covered)

    windows = F.transform(upto(F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))


class Features:
    """What rules look at, as expressions over a text and its words; `known` has those that are columns already."""

    def __init__(self, text: Column, words: Column, **known: Column):
        self.text, self.words, self.known = text, words, known

    def __getattr__(self, name: str) -> Column:
        made = {
            "n_words": lambda: F.size(self.words), "word_chars": lambda: word_chars(self.words), "n_symbols": lambda: count_chars(self.text, SYMBOLS),
            "n_dup_lines": lambda: dup_lines(self.text), "n_lines": lambda: F.size(lines_with_words(self.text)), "n_repeat_words": lambda: repeat_words(self.words),
            "n_upper": lambda: count_chars(self.text, "A-Z"), "n_letters": lambda: F.length(F.regexp_replace(self.text, r"[^\p{L}]+", "")), "n_distinct": lambda: F.size(F.array_distinct(self.words)),
        }
        if name not in made:
            raise AttributeError(name)
        return self.known[name] if name in self.known else made[name]()


@dataclass(frozen=True)
class Rule:
    """Rejects a row where `rejects(features)` holds, which is never null."""

    name: str
    rejects: Callable[[Features], Column]


#: The base rules come with the contract of the query; the others are this cascade's own. Bounds are whole
#: numbers, wide enough for prose in any of the usual scripts, so ordinary documents stay.
BASE = (
    Rule("few_words", lambda f: f.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > REPEAT_PERCENT * f.n_words),
)
CASCADE = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("shouting", lambda f: 10 * f.n_upper > 4 * f.word_chars),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words)),
    Rule("duplicate_lines", lambda f: 10 * f.n_dup_lines > 3 * f.n_lines),
    Rule("few_letters", lambda f: 2 * f.n_letters < f.word_chars),
    Rule("low_variety", lambda f: 100 * f.n_distinct < 3 * f.n_words),
)


def plan(df: DataFrame, text: str, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules with cost (seconds), rejection (share of the sample) and rank, best rejection per cost first.

    The sample holds about `sample_rows` rows, drawn from the whole table; it is written to the shared
    folder once so that each rule is timed on the same stored rows. A rule's cost is the median of REPEATS runs, after a run that is not
    counted, less the median of a rule that looks at nothing, which pays for the job and for reading; differences within that
    rule's own spread count as one cost, so that chance does not order cheap rules.
    """
    rows = df.count()
    if not rows:
        return [{"rule": r, "cost": 0.0, "rejection": 0.0} for r in rules]
    spark, share = df.sparkSession, min(1.0, sample_rows / rows)
    path = new_path(spark, "quality-sample")
    drawn = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).sample(share, 11)
    sample = materialise(drawn.select("t", split_words(F.col("t")).alias("w")), "quality-sample", path)
    features = Features(F.col("t"), F.col("w"))

    def timed(value: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share_out = sample.agg(F.avg(value.cast("double")), F.count("t"), F.sum(F.size("w"))).first()[0] or 0.0
        return time.perf_counter() - began, share_out

    nothing, runs = F.lit(False), []
    tried = [nothing, *(r.rejects(features) for r in rules)]
    for turn in range(REPEATS + 1):
        took = [timed(x) for x in tried]
        if turn:  # the first turn starts code generation and workers
            runs.append([t for t, _ in took])
    cost = [median(x) for x in zip(*runs, strict=True)]
    noise = max(1e-6, (max(x[0] for x in runs) - min(x[0] for x in runs)) / 2)
    found = [{"rule": r, "cost": max(c - cost[0], noise), "rejection": share_out} for r, c, (_, share_out) in zip(rules, cost[1:], took[1:], strict=True)]
    forget(spark, path)
    return sorted(found, key=lambda x: (-x["rejection"] / x["cost"], x["cost"]))


def with_verdict(df: DataFrame, rules: list[Rule], text: str = "text", rejected_by: str = "rejected_by") -> DataFrame:
    """Adds `rejected_by`: the first rule of the cascade that rejects the row, null where none does.

    The verdict is one expression that binds the words itself: as a column of its own they would be put back into every use
    of them when a filter on the verdict is pushed down, and be split again for each word.
    """
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def verdict(t: Column, w: Column, chars: Column) -> Column:
        case, features = F, Features(t, w, word_chars=chars)
        for r in rules:
            case = case.when(r.rejects(features), F.lit(r.name))
        return case

    bound = let(own, lambda t: let(split_words(t), lambda w: let(word_chars(w), lambda chars: verdict(t, w, chars)))) if rules else F.lit(None).cast("string")
    return df.withColumn(rejected_by, bound)


def filter_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the whole cascade, base rules included, lets through; columns as they were."""
    mark = reserve(df, "rejected")["rejected"]
    ordered = [x["rule"] for x in plan(df, text, BASE + CASCADE)]
    return with_verdict(df, ordered, text, mark).where(F.col(mark).isNull()).drop(mark)


def report(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the counts, the base verdict and the cascade's verdict, a row for each row of df.

    The counts are wanted of every row, so they are made before the cascade, which then saves only what its rules count besides
    (capitals, letters, lines, distinct words); filter_documents() saves whole rules.
    """
    rules = [x["rule"] for x in plan(df, text, CASCADE)]
    rows = df.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("w", split_words(F.col("t")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = Features(F.col("t"), F.col("w"))
    rows = rows.select("doc_id", "t", "w", *(getattr(own, c).cast("long").alias(c) for c in counts))
    known = Features(F.col("t"), F.col("w"), **{c: F.col(c) for c in counts})
    case = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        case = case.when(r.rejects(known), F.lit(r.name))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("rejected_by", case)
    return rows.select("doc_id", *counts, "base_failed", F.col("rejected_by").isNull().alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
keyed AS (SELECT rid, p, [w[p], w[p + 1], w[p + 2]] AS k FROM tri),
rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed),
hit AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep WHERE c > 1) GROUP BY rid),
f AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct,
             length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters
      FROM w LEFT JOIN hit USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 4 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_letters < word_chars OR 100 * n_distinct < 3 * n_words) AS kept
FROM b
"""
