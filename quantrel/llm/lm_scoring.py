r"""Operator 6: stupid-backoff language-model scores, computed relationally.

The model: counts of all n-grams of 1 to ORDER words over the whole corpus, every word and n-gram included. A word w after a history h
scores c(h w) / c(h) where c(h w) reaches LEAST_COUNT, else ALPHA times its score after the history without its first word; a single
word scores max(1, c(w)) / N, N being the words of the corpus. Only steps back that are taken cost ALPHA: a document's first word has no
history and pays none. LEAST_COUNT is the evidence that a history needs: with 1, a text that is part of the corpus never steps back,
since each of its n-grams occurs at least once, in itself. Words are `[^\x20\x09-\x0D]+`.

The plan has three tables.
- grams: each block of documents (about BLOCK_BYTES of text) explodes its n-grams to 64-bit hashes and counts them; a row holds the block's
  distinct hashes of one hash bucket, sorted, with their counts. An n-gram costs a block one entry, however frequent it is.
- counts: grouped by bucket, the entries of all blocks are summed: the bucket's part of the n-gram count table. Joined to the entries that were
  sent, it gives for each block and bucket the corpus counts in the order of its hashes.
- scores: grouped by block, the counts meet the block's texts, each word takes its longest known history, and logs are summed by document.
Buckets and blocks are bounded in size and their number grows with the corpus, so no task gathers more at a larger scale; a word that makes a third of
the corpus is one entry of each block. Blocks are named by the hash of their contents: both reads of docs must hand out the same rows in
the same order (files do); if they don't, the counts are missing and the job stops with an error. Two n-grams share a count if their
64-bit hashes are equal, which for m distinct n-grams happens to one in 2**64 / m of them.

Defined cases: a null or empty text has no words, score 0 and null mean. Repeated rows count, and are scored, as documents of their own. A text longer
than a block is a block of its own. An empty table gives an empty result; an empty corpus counts as N = 1. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, split_words, table

ALPHA, ORDER, LEAST_COUNT = 0.4, 3, 2
#: Text of a block, and text of the corpus for each hash bucket of the count tables.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
#: Bytes that are hashed together.
CHUNK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.random.default_rng(6).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
U = np.uint64


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64."""
    out = np.full(n + 1, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def words_of(data: bytes, chunk_bytes: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of UTF-8 text: the sum of its bytes' values times powers of BASE, mixed."""
    raw = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    n = chunk_bytes
    while at < len(raw):
        end = min(at + n, len(raw))
        while end < len(raw) and not SEPARATOR[raw[end]]:  # a word that reaches over the end of the chunk
            more = np.flatnonzero(SEPARATOR[raw[end : end + n]])
            end = end + int(more[0]) if len(more) else min(end + n, len(raw))
        part = raw[at:end]
        inside = np.concatenate([[False], ~SEPARATOR[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        most = max(n, len(part))
        up, down = powers(BASE, most), powers(pow(BASE, -1, 1 << 64), most)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[part] * up[: len(part)])])
        starts.append(first + at)
        hashes.append(mixed((sums[last] - sums[first]) * down[first]))
        at = end
    return np.concatenate([np.empty(0, np.int64), *starts]), np.concatenate([np.empty(0, np.uint64), *hashes])


class Block:
    """Words and n-grams of some texts: words by text, and for k = 1, 2, .. the hash of the k words from each place on."""

    def __init__(self, texts: list[bytes], order: int):
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        starts, words = words_of(b"\n".join(texts))
        self.n_words = np.diff(np.searchsorted(starts, offsets))
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_words)
        first = np.concatenate([[0], np.cumsum(self.n_words)])[:-1]
        self.place = np.arange(len(words), dtype=np.int32) - first.astype(np.int32)[self.doc]
        self.grams, last = [], np.zeros(len(words), np.uint64)
        for k in range(1, order + 1):
            n = max(0, len(words) - k + 1)
            whole = self.doc[:n] == self.doc[k - 1 :] if n else np.zeros(0, bool)
            last = mixed(last[:n] * U(0xD6E8FEB86659FD93) + words[k - 1 :] + U(k))
            self.grams.append((last, whole))

    def entries(self) -> np.ndarray:
        return np.concatenate([g[whole] for g, whole in self.grams])


def planes(x: np.ndarray) -> bytes:
    """Bytes of the values, all lowest ones first, so that the many zero bytes lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def values(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(planes, arrays)))


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw, widths = zstandard.ZstdDecompressor().decompress(data), [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(values(raw[at : at + n * width], kind))
        at += n * width
    return out


def bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted hashes begins and ends; a bucket is a range of hashes."""
    edges = np.array([min((b << 64) // buckets, (1 << 64) - 1) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """Consecutive rows of a task, cut into blocks: name (hash of the contents), ids and texts."""

    def block() -> tuple[int, pa.Array, list[bytes]]:
        name = xxhash.xxh64()
        for t in texts:
            name.update(len(t).to_bytes(8, "little"))
            name.update(t)
        return name.intdigest() - (1 << 63), pa.concat_arrays(ids), texts

    ids, texts, size = [], [], 0
    for batch in batches:
        own, start = [(t or "").encode() for t in batch.column(1).to_pylist()], 0
        for i, t in enumerate(own):
            if texts and size + len(t) > block_bytes:
                if i > start:
                    ids.append(batch.column(0).slice(start, i - start))
                yield block()
                ids, texts, size, start = [], [], 0, i
            texts.append(t)
            size += len(t) + 1
        if len(own) > start:
            ids.append(batch.column(0).slice(start))
    if texts:
        yield block()


def sent_grams(rows: DataFrame, order: int, buckets: int, counted: bool, asked: bool, block_bytes: int) -> DataFrame:
    """block, bucket, body (distinct hashes as differences, and their counts in the block), counted, asked."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in blocks(batches, block_bytes):
            hashes, n = np.unique(Block(texts, order).entries(), return_counts=True)
            steps, n, cuts = np.diff(hashes, prepend=U(0)), n.astype(np.uint32), bounds(hashes, buckets)
            for b in np.flatnonzero(np.diff(cuts)):
                at, own = slice(cuts[b], cuts[b + 1]), steps[cuts[b] : cuts[b + 1]].copy()
                own[0] = hashes[cuts[b]]
                yield pa.RecordBatch.from_pylist([{"block": name, "bucket": int(b), "body": packed(own, n[at]), "counted": counted, "asked": asked}], schema)

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary()), ("counted", pa.bool_()), ("asked", pa.bool_())])
    return rows.mapInArrow(explode, "block long, bucket int, body binary, counted boolean, asked boolean")


def corpus_counts(sent: DataFrame) -> DataFrame:
    """block, bucket, body: for each asked block and bucket the corpus counts of its hashes, in their order."""

    def count(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        parts = [unpacked(r["body"], np.uint64, np.uint32) for r in rows]
        n = np.concatenate([c if r["counted"] else np.zeros(len(c), np.uint32) for r, (_, c) in zip(rows, parts, strict=True)])
        _, which = np.unique(np.concatenate([np.cumsum(steps) for steps, _ in parts]), return_inverse=True)
        total = np.bincount(which, weights=n).astype(np.uint64)[which]
        out, at = {}, 0
        for r, (steps, _) in zip(rows, parts, strict=True):
            if r["asked"] and r["block"] not in out:
                out[r["block"]] = packed(total[at : at + len(steps)])
            at += len(steps)
        return pa.table({"block": pa.array(out.keys(), pa.int64()), "bucket": pa.array([rows[0]["bucket"]] * len(out), pa.int32()), "body": pa.array(out.values(), pa.binary())})

    return sent.groupBy("bucket").applyInArrow(count, "block long, bucket int, body binary")


def block_texts(rows: DataFrame, kind: str, block_bytes: int) -> DataFrame:
    """block, bucket (-1), body (the texts) and ids, a row for each block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in blocks(batches, block_bytes):
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(np.array([len(t) for t in texts], np.uint64).tobytes() if i < 0 else texts[i] for i in range(-1, len(texts))))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([-1], pa.int32()), pa.array([body], pa.binary()), pa.ListArray.from_arrays([0, len(ids)], ids)], ["block", "bucket", "body", "ids"])

    return rows.mapInArrow(pack, f"block long, bucket int, body binary, ids array<{kind}>")


def backed_off(block: Block, counts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By word: log of the relative frequency after its longest known history (for a word alone, of its count), words of that history, steps back."""
    n, order = len(block.doc), len(counts)
    term, held, open_ = np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(order, 1, -1):
        at = np.flatnonzero(open_ & (block.place >= k - 1))
        at = at[counts[k - 1][at - k + 1] >= least]
        term[at] = np.log(counts[k - 1][at - k + 1]) - np.log(counts[k - 2][at - k + 1])
        held[at], open_[at] = k - 1, False
    term[open_] = np.log(np.maximum(counts[0][open_], 1))
    return term, held, np.minimum(block.place, order - 1) - held


def block_scores(rows: DataFrame, kind: str, order: int, least: int) -> DataFrame:
    """doc_id, n_words, n_seen, back (steps back) and terms (logs without ALPHA and N) for each document of the blocks' texts."""

    def judge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["bucket"])
        own, told = [r for r in rows if r["bucket"] < 0], [r["body"] for r in rows if r["bucket"] >= 0]
        raw = zstandard.ZstdDecompressor().decompress(own[0]["body"]) if own else b""
        n = len(own[0]["ids"]) if own else 0
        sizes = np.frombuffer(raw[: 8 * n], np.uint64).astype(np.int64)
        ends = 8 * n + np.cumsum(sizes)
        block = Block([raw[e - s : e] for s, e in zip(sizes, ends, strict=True)], order)
        del raw
        entries = block.entries()
        by_hash = np.argsort(entries)
        entries = entries[by_hash]
        new = np.concatenate([np.zeros(1, np.int32), entries[1:] != entries[:-1]])[: len(entries)].cumsum(dtype=np.int32)
        del entries
        which = np.empty(len(new), np.int32)
        which[by_hash] = new
        n_known = int(new[-1]) + 1 if len(new) else 0
        del by_hash, new
        known = np.concatenate([np.empty(0, np.uint64), *(unpacked(b, np.uint64)[0] for b in told)])
        if not own or len(known) != n_known:
            raise RuntimeError("the two reads of the documents gave other rows or another order: write them to a table first")
        counts, at = [], 0
        for g, whole in block.grams:
            c = np.zeros(len(g))
            c[whole] = known[which[at : at + whole.sum()]]
            counts.append(c)
            at += whole.sum()
        term, held, back = backed_off(block, counts, least)
        by = lambda x: np.bincount(block.doc, weights=x, minlength=n).astype(float)
        figures = [block.n_words, by(held > 0).astype(np.int64), by(back).astype(np.int64), by(term)]
        out = [pa.concat_arrays([pa.array(r["ids"], ids) for r in own])] + [pa.array(np.tile(x, len(own))) for x in figures]
        return pa.Table.from_arrays(out, names=["doc_id", "n_words", "n_seen", "back", "terms"])

    ids = to_arrow_type(rows.schema["ids"].dataType.elementType)
    return rows.groupBy("block").applyInArrow(judge, f"doc_id {kind}, n_words long, n_seen long, back long, terms double")


def scores(docs: DataFrame, corpus: DataFrame | None = None, text: str = "text", id_column: str = "doc_id", order: int = ORDER, least: int = LEAST_COUNT, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_seen (words scored after a history), log_score and mean_log_score, a row for each row of docs; the model is of `corpus`, else of docs."""
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    plain = lambda df, key: df.select(key.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = plain(docs, F.col(f"`{id_column}`"))
    model = rows if corpus is None else plain(corpus, F.lit(None).cast(kind))
    size = model.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bucket_bytes))
    sent = sent_grams(rows, order, buckets, corpus is None, True, block_bytes)
    if corpus is not None:
        sent = sent.union(sent_grams(model, order, buckets, True, False, block_bytes))
    told = corpus_counts(sent).withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    found = materialise(block_scores(told.union(block_texts(rows, kind, block_bytes)), kind, order, least), "lm-terms")
    words = found.agg(F.sum("n_words")) if corpus is None else model.agg(F.sum(F.size(split_words(F.col("t")))))
    rest = F.lit(math.log(max(1, words.first()[0] or 0)))
    log_score = F.col("terms") + F.col("back") * F.lit(math.log(ALPHA)) - (F.col("n_words") - F.col("n_seen")) * rest
    return found.select("doc_id", "n_words", "n_seen", F.round(log_score, 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(log_score / F.col("n_words"), 6)).alias("mean_log_score"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT rid, p, ws[p] AS w, CASE WHEN p > 1 THEN ws[p - 1] END AS v, CASE WHEN p > 2 THEN ws[p - 2] END AS u FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
total AS (SELECT greatest(1, count(*)) AS n FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE p > 1 GROUP BY ALL),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE p > 2 GROUP BY ALL),
s AS (SELECT t.rid, CASE WHEN c3.c >= 2 OR c2.c >= 2 THEN 1 ELSE 0 END AS seen,
             CASE WHEN c3.c >= 2 THEN ln(c3.c::DOUBLE) - ln(h2.c::DOUBLE)
                  WHEN c2.c >= 2 THEN CASE WHEN p > 2 THEN ln(0.4::DOUBLE) ELSE 0 END + ln(c2.c::DOUBLE) - ln(h1.c::DOUBLE)
                  ELSE least(p - 1, 2) * ln(0.4::DOUBLE) + ln(c1.c::DOUBLE) - ln(total.n::DOUBLE) END AS term
      FROM t JOIN c1 USING (w) LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w
             LEFT JOIN c1 h1 ON h1.w = t.v LEFT JOIN c2 h2 ON h2.v = t.u AND h2.w = t.v, total),
g AS (SELECT rid, sum(seen) AS seen, sum(term) AS score FROM s GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(seen, 0)::BIGINT AS n_seen, round(coalesce(score, 0), 6) AS log_score,
       CASE WHEN len(ws) > 0 THEN round(score / len(ws), 6) END AS mean_log_score
FROM d LEFT JOIN g USING (rid)
"""
