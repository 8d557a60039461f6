"""The pipeline's stages: columns, decisions and odd tables."""

import re

import pytest

import corpus_pipeline
from quantrel.llm import simhash

PROSE = " ".join(f"{w}word" for w in "north river stone light grass cloud water field bread table chair house glass paper horse train plane ocean mountain valley forest garden window door street bridge school market village city harbour island desert meadow orchard castle temple museum library station factory hospital theatre stadium airport tower palace fountain statue square avenue".split())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text):
    return (i, text, "en", "s", len(text or ""))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"bench{i}word" for i in range(30))
    rows = [doc(1, PROSE), doc(2, PROSE), doc(3, PROSE.replace("north", "south") + " mail a@b.example ip 10.0.0.1 end"), doc(4, "too short"), doc(5, None), doc(6, f"{PROSE[::-1]} {passage}"), doc(7, "# $ % " * 60), doc(8, " ".join(f"other{i}thing{chr(97 + i % 26)}" for i in range(90))), doc(9, " ".join(f"{chr(97 + i % 26)}kind{i}of" for i in range(80)) + ' mail a@b.example ip 10.0.0.1 token = "08813ad77930c5f691325605b62c9dfd1b407297" end')]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept["quality_rules"] == {1, 2, 3, 6, 8, 9}
    # 3 shares 46 of 53 five-word shingles with 1, which is 0.87 and over the stage's 0.8
    assert kept["simhash_near_dedup"] == {1, 6, 8, 9}
    assert kept["benchmark_decontamination"] == kept["pii"] == {1, 8, 9}
    masked = docs.where("doc_id = 9").first()
    assert "<email>" in masked["text"] and "<ip>" in masked["text"] and "<secret>" in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert not re.search("a@b|10[.]0[.]0|08813ad7", masked["text"])
    out = corpus_pipeline.run(spark, tables).collect()
    assert {r["doc_id"] for r in out} == {1, 8, 9} and all(r["round_trip"] for r in out)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute_groups(rows):
    """Groups of ids whose texts are linked by a similarity of 0.8 or more, by all pairs that share a shingle."""
    sets, holders, root = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders.get(g, ())}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for g in s:
            holders.setdefault(g, []).append(i)
    return {rows[find(i)][0] for i in range(len(rows))}


def test_whole_run_against_plain_python(spark):
    """Every decision of a run over the smallest tables, by rules and pairs written out in Python."""
    from test_native import brute_hits, brute_quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    letters = lambda t: sum(c.isalpha() for c in t)

    def good(t):
        n, chars, symbols, dup, _, failed = brute_quality(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        upper = len(re.findall("[A-Z]", t))
        return not (failed or 10 * symbols > n or 10 * upper > 4 * chars or chars < 2 * n or chars > 20 * n or 10 * dup > 3 * len(lines) or 2 * letters(t) < chars or 100 * len(set(words)) < 3 * n)

    kept = [(i, t) for i, t in rows if good(t or "")]
    firsts = brute_groups(kept)
    clean = {i for (i, t), h in zip(kept, brute_hits(kept, items), strict=True) if i in firsts and not h[-1]}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == clean and all(r["round_trip"] for r in got) and 0 < len(clean) < len(firsts) <= len(kept) < len(rows)


def test_odd_rows(spark, tables):
    """Null ids, repeated rows, a very long text and columns with names that the stages use within."""
    long = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(30_000))
    rows = [(None, PROSE, 1, "a"), (None, PROSE, 1, "a"), (7, PROSE, 2, "b"), (7, PROSE, 3, "b"), (8, long, 4, "c"), (None, None, 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int, `__own` string")
    dedup = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(map(str, dedup(spark, docs, tables).collect())) == sorted(map(str, dedup(spark, spark.createDataFrame(rows[::-1], docs.schema), tables).collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, tables)
        assert got.columns == docs.columns
        docs = spark.createDataFrame(got.collect(), docs.schema)
    assert [(r["doc_id"], len(r["text"])) for r in docs.orderBy("doc_id").collect()] == [(7, len(PROSE)), (8, len(long))]
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()} == {7, 8}


def test_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        docs = spark.createDataFrame([], docs.schema) if docs.count() == 0 else docs
    assert docs.collect() == []


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]
    assert simhash.RADIUS == 2
