"""Operator 7: WARC archives in seekable Zstandard bundles.

Records go into frames of about FRAME_BYTES, each compressed by itself, and frames into bundles of about
BUNDLE_BYTES. A bundle ends with a skippable frame that holds the seek table (compressed and plain size of each frame) in
the public seekable format. An index maps each record to its frame and the offset within that frame, so one
record is read by decompressing one frame. Bundles are rows of a Parquet table (bundle, data, index), which Spark's
own writer commits: any store works, and a lost executor's half-written bundles never show.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest id is the response and the others
revisit it; smaller ones are all responses.

Defined cases: a null html is an empty payload, a null url has no target header, a null id no id header (such a record
is never the one that others revisit, unless none has an id: then all are responses). Rows that repeat
the largest id are all responses. A payload of any length is one record in one frame. An empty table gives
no bundles. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 23, 3
#: Fixed values of the seekable format and of the record profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

BUNDLE_SCHEMA = "bundle string, data binary, index array<struct<record:string,frame:int,offset:int,length:int>>"
RECORD_SCHEMA = "record string, page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle without checksums")
    out, start = [], 0
    for packed, plain in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, plain = place
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id, url, payload, size, digest, kind, refers_to) -> tuple[str, bytes]:
    name, block = record_id(page_id, digest), b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%!*'();:@&=+$,/?#[]~|{}^`\"<>\\ ")))
    if kind == "revisit":
        head += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to), ("WARC-Profile", PROFILE)]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return name, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, and the payload without its HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def pack(records: Iterable[tuple[str, bytes]], frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Iterator[tuple[bytes, list[dict]]]:
    """Bundles with their indexes; at most one bundle and one frame are held."""
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    frame, frames, sizes, index, plain = bytearray(), bytearray(), [], [], 0

    def close() -> None:
        packed = press.compress(bytes(frame))
        sizes.append((len(packed), len(frame)))
        frames.extend(packed)
        frame.clear()

    for name, data in records:
        if frame and len(frame) + len(data) > frame_bytes:
            close()
            if plain >= bundle_bytes:
                yield bytes(frames) + seek_table(sizes), index
                frames.clear()
                sizes, index, plain = [], [], 0
        index.append({"record": name, "frame": len(sizes), "offset": len(frame), "length": len(data)})
        frame.extend(data)
        plain += len(data)
    if frame:
        close()
        yield bytes(frames) + seek_table(sizes), index


def nothing(x):
    return None if x is None or x is pd.NA or x != x else x


def write_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    records = (
        record_bytes(nothing(r.page_id), nothing(r.url), bytes(nothing(r.payload) or b""), int(r.payload_bytes), r.payload_digest, r.record_type, nothing(r.refers_to))
        for batch in batches for r in batch.itertuples(index=False)
    )
    for i, (data, index) in enumerate(pack(records)):
        yield pd.DataFrame({"bundle": [f"{part:06d}-{i:06d}"], "data": [data], "index": [index]})


def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for batch in batches:
        for data, index in zip(batch["data"], batch["index"], strict=True):
            rows, places, current, frame = [], frame_places(data), -1, b""
            for x in index:
                if x["frame"] != current:
                    current, frame = x["frame"], read_frame(data, places[x["frame"]])
                head, payload = parse_record(frame[x["offset"] : x["offset"] + x["length"]])
                stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"record {x['record']} is damaged")
                rows.append((x["record"], head.get("X-Page-Id"), head.get("WARC-Target-URI"), payload if head["WARC-Type"] == "response" else None, int(head["X-Payload-Length"]), stated, head["WARC-Type"], head.get("X-Refers-To-Page-Id")))
            yield pd.DataFrame(rows, columns=["record", "page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def records(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The table of records to write. The payload travels once, in the join that finds its response."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    many = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    many = many.where("n > 1 and first is not null").drop("n")
    rows = rows.join(many, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        F.col("page_id").cast("string"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
    )


def write_bundles(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> None:
    records(pages, id_column, url, html).mapInPandas(write_batches, BUNDLE_SCHEMA).write.mode("overwrite").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles, found by the index and checked against its digest."""
    return spark.read.schema(BUNDLE_SCHEMA).parquet(path).mapInPandas(read_batches, RECORD_SCHEMA)


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_bundles(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    return read_bundles(spark, path).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
