"""Decontamination, quality rules and SimHash against brute force, and on odd tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quantrel.llm import decontamination, near_copies, quality_rules, simhash

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i * i % 400] for i in range(70_000))
PROSE = " ".join(f"{w}word" for w in "north river stone light grass cloud water field bread table chair house glass paper horse train plane ocean mountain valley forest garden window door street bridge school market village city harbour island desert meadow orchard castle temple museum library station factory hospital theatre stadium airport tower palace fountain statue square avenue".split())


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    prints = {i: brute_print(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def near(i):
    w = PROSE.split() * 3
    w[i % len(w)] = f"x{i // len(w)}"
    return " ".join(w)


def op10(spark, rows, monkeypatch, schema=DOCS):
    monkeypatch.setattr(simhash, "table", lambda *a: spark.createDataFrame(rows, schema))
    return simhash.op10_simhash_pivots(spark, "")


def test_simhash_against_brute_force(spark, monkeypatch):
    rows = [(i, near(i)) for i in range(150)] + [(200 + i, " ".join(WORDS[(i * 7 + j * (i + 1)) % 400] for j in range(30 + i))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "One two"), (305, "ÀB ÀB àb"), (306, LONG), (307, LONG), (308, LONG + " tail")]
    want = brute_components(rows)
    for cell, depth in ((0, 2), (4, 1), (48, 5)):  # cells that are dealt anew and cells that are paired at once give the same components
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "MAX_DEPTH", depth)
        assert {tuple(r) for r in op10(spark, rows, monkeypatch).collect()} == want
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_bands_keep_every_linked_pair():
    """On some path of bands, each round's band is free of any two given bits."""
    rng = np.random.default_rng(5)

    def met(open_bits, differing, depth):
        parts = simhash.parts_of(open_bits)
        assert sorted(b for p in parts for b in p) == sorted(open_bits)
        return depth == 0 or any(not differing & set(p) and met(tuple(b for b in open_bits if b not in p), differing, depth - 1) for p in parts)

    assert all(met(tuple(range(64)), set(rng.choice(64, 2, replace=False).tolist()), simhash.MAX_DEPTH + 1) for _ in range(300))


def test_simhash_odd_tables(spark, monkeypatch):
    assert op10(spark, [], monkeypatch).collect() == []
    rows = [(1, PROSE), (1, PROSE), (None, PROSE), (2, "other words here")]
    got = sorted((str(r.doc_id), r.component_id) for r in op10(spark, rows, monkeypatch).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]
    df = spark.createDataFrame([(1, PROSE, 3, "a"), (1, PROSE, 3, "a"), (5, PROSE, 4, "b"), (2, "other", 5, "c")], "doc_id long, text string, fp long, `component` string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert simhash.keep_one(df.limit(0)).collect() == []
    mixed = spark.createDataFrame([(7, PROSE), (7, "other text of its own"), (3, PROSE), (None, None), (None, ""), (None, "single null")], DOCS)
    assert sorted(map(str, simhash.keep_one(mixed).collect())) == sorted(map(str, mixed.where("doc_id = 3 or text in ('other text of its own', 'single null')").collect() + simhash.keep_one(mixed).where("coalesce(text, '') = ''").collect()))
    assert simhash.keep_one(mixed).where("coalesce(text, '') = ''").count() == 1


def test_near_copies_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(25):
        words = [f"b{base}x{j}" for j in range(60 + base)]
        for copy in range(5):
            own = words[: len(words) - 2 * copy]
            for at in rng.integers(0, len(own), copy % 3):
                own[at] = f"edit{base}x{copy}x{at}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (None, "one two")]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    want = {min((i for (i, _), r in zip(rows, root, strict=True) if r == x and i is not None)) for x in set(root)}
    df = spark.createDataFrame(rows, DOCS)
    for cell in (2, 48):  # cells too large for pairs, and pairs, give the same groups
        monkeypatch.setattr(near_copies, "CELL", cell)
        assert {r.doc_id for r in near_copies.keep_one(df).collect()} == want
    assert 25 < len(want) < 100 and len(want) < simhash.keep_one(df).count()
    assert near_copies.keep_one(df.limit(0)).collect() == []


def test_pipeline_drops_near_copies(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:40] + ["edited"] + words[41:]))]
    assert [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()] == [1]


def brute_hits(docs, items):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for doc, t in docs:
        w, places, met = words(t), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if found := i + n <= len(w) and windows.get(tuple(w[i : i + n])):
                    places |= set(range(i, i + n))
                    met |= {str(x) for x in found if x is not None}
        yield doc, len(w), len(places), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(places)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination_against_brute_force(spark, bound):
    a, b = " ".join(WORDS[:35]), " ".join(WORDS[100:112])
    items = [(1, a), (2, b), (3, "Zebra quagga"), (4, None), (5, "..."), (10, a), (11, " ".join(WORDS[20:60])), (None, " ".join(WORDS[300:315]))]
    docs = [(1, f"pre {a} post"), (2, " ".join(WORDS[5:15])), (3, " ".join(WORDS[5:14])), (4, "a ZEBRA; quagga! zebra quagga"), (5, None), (6, ""), (7, f"{b.upper()} {b}"), (8, LONG), (9, " ".join(WORDS[300:320])), (9, " ".join(WORDS[300:320])), (None, a), (12, "é" * 50_000)]
    got = decontamination.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), bound)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_hits(docs, items)))


def test_decontamination_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b", "x", 2), (2, PROSE, "y", 3)], "doc_id long, text string, th string, h int")
    assert [r.n_hit for r in decontamination.report(docs, none).collect()] == [0, 0]
    assert decontamination.report(docs.limit(0), none).collect() == []
    items = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, places, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        places |= {i, i + 1, i + 2} if count[x] > 1 else set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(places), failed


def test_quality_against_brute_force(spark):
    texts = [None, "", " \x0b\x0c", PROSE, PROSE + "\n" + PROSE, "a b c a b c a b c d " * 9, "x\n\n x\nx\ny\n" + PROSE, "# ** $%& |<> " + PROSE, LONG, PROSE.upper(), "é " * 60, "a" * 90_000, PROSE]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.report(df).collect()}
    assert {k: v[:-1] for k, v in got.items()} == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert {i for i, v in got.items() if v[-1]} == {3, 6, 12}


def test_slow_rules_rank_below_fast_ones(spark):
    df = spark.createDataFrame([(i, PROSE * 20) for i in range(400)], DOCS)
    slow = quality_rules.Rule("slow", lambda f: f.n_repeat_words >= 0)
    fast = quality_rules.Rule("fast", lambda f: f.n_words >= 0)
    idle = quality_rules.Rule("idle", lambda f: f.n_words < 0)
    steps = quality_rules.plan(df, "text", (slow, idle, fast))
    assert [s["rule"].name for s in steps] == ["fast", "slow", "idle"] and [s["rejection"] for s in steps] == [1, 1, 0]
    assert steps[0]["cost"] < steps[1]["cost"]


def test_cascade_order_changes_no_verdict(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, PROSE, PROSE.upper(), "Short text.", "| a | b " * 60])], DOCS + ", `w` int")
    kept = {r.doc_id for r in quality_rules.filter_documents(df).collect()}
    rules = list(quality_rules.BASE + quality_rules.CASCADE)
    for order in (rules, rules[::-1]):
        assert {r.doc_id for r in quality_rules.with_verdict(df, order).where("rejected_by is null").collect()} == kept == {1}
    assert quality_rules.filter_documents(df).columns == df.columns
    assert quality_rules.filter_documents(df.limit(0)).collect() == []
    steps = quality_rules.plan(df, "text", quality_rules.CASCADE)
    gain = [s["rejection"] / s["cost"] for s in steps]
    assert gain == sorted(gain, reverse=True)


def test_near_copies_go_through_simhash(spark, monkeypatch):
    """The stage's candidates come from SimHash fingerprints and pivots too; minimum hashes alone stood in for them."""
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(3)]
    texts += [texts[0] + " end", "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, real = [], near_copies.link_table
    monkeypatch.setattr(near_copies, "link_table", lambda prints: met.append((prints, real(prints))) or met[-1][1])
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == {0, 1, 2, 4, 5}
    want = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(df, ["doc_id"], "text", near_copies.SHINGLE).collect()}
    assert {r["fp"] for r in met[0][0].collect()} == set(want.values())
    near = {tuple(sorted((want[a], want[b]))) for a in want for b in want if want[a] != want[b] and bin((want[a] ^ want[b]) & (1 << 64) - 1).count("1") <= 2}
    assert {tuple(sorted((r["a"], r["b"]))) for r in met[0][1].collect()} == near
