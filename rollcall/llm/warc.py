"""WARC archives through a chunked record table.

A payload is never held as one new value: it is cut into chunk rows
(record id, chunk number, bytes) of at most ``chunk_bytes``, each carrying the SHA-1 of
the payload up to its end, so the last chunk carries the payload's digest. Each chunk
is one WARC record: the first a ``response``, the others ``continuation`` records with
segment numbers, as the WARC format has it for split records. Reading streams the
chunks of a record in order through one running digest, again one chunk at a time, and
fails on any length, order or digest that does not match.

Archives are written and read by Spark's text source with the line ends that WARC
prescribes, so they lie wherever Spark can write, and a lost task only rewrites its
own file. The reader cuts files at the version line ``WARC/1.1``; the chunker also ends
a chunk inside every such text in a payload, so it never occurs in a block.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import arrow_rows, materialize, small, table
from rollcall.session import scratch_path

CHUNK_BYTES = 64 * 1024
VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MARK = VERSION.encode()
_BATCH_BYTES = 4 << 20

CHUNKS = ("page_id long, url string, copy long, chunk int, chunks int, data binary, prefix_digest string, "
          "payload_bytes long, payload_digest string")


def base32_sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


def spans(view: memoryview, chunk_bytes: int) -> list[tuple[int, int]]:
    """Cuts of a payload: every ``chunk_bytes``, and five bytes into each version text."""
    n = len(view)
    cuts, at = [], 0
    marks = []
    for lo in range(0, n, CHUNK_BYTES):
        # As many bytes more as a version text that starts on the last one needs.
        piece = bytes(view[lo:lo + CHUNK_BYTES + len(_MARK) - 1])
        i = piece.find(_MARK)
        while i >= 0:
            marks.append(lo + i + 5)
            i = piece.find(_MARK, i + 1)
    for stop in [*marks, n]:
        while stop - at > chunk_bytes:
            cuts.append((at, at + chunk_bytes))
            at += chunk_bytes
        if stop > at or not cuts:
            cuts.append((at, stop))
            at = stop
    return cuts


def running_digests(view: memoryview, parts: list[tuple[int, int]]) -> list[str]:
    """Digest of the payload up to the end of each part; the last is the payload's."""
    h, out = hashlib.sha1(), []
    for lo, hi in parts:
        for at in range(lo, hi, CHUNK_BYTES):
            h.update(view[at:min(hi, at + CHUNK_BYTES)])
        out.append(base32_sha1(h))
    return out


def payload_digests(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of each row, hashed in chunk-sized steps."""
    def run(batches):
        for b in batches:
            rows = []
            for v in b.column(1):
                buf = memoryview(v.as_buffer() or b"")
                h = hashlib.sha1()
                for at in range(0, len(buf), CHUNK_BYTES):
                    h.update(buf[at:at + CHUNK_BYTES])
                rows.append((len(buf), base32_sha1(h)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
                names=["page_id", "payload_bytes", "payload_digest"])

    arrow_rows(pages.sparkSession, 256)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), _binary(payload).alias("payload")).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string")


def _binary(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string").cast("binary"), F.lit(b""))


def chunk_table(pages: DataFrame, payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of every page. A null or empty payload is one chunk of no bytes."""
    def run(batches):
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(),
                 pa.int64(), pa.string()]

        def flush(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            rows, held = [], 0
            for page, url, copy, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                          b.column(2).to_pylist(), b.column(3)):
                view = memoryview(v.as_buffer() or b"")
                parts = spans(view, chunk_bytes)
                digests = running_digests(view, parts)
                for k, (lo, hi) in enumerate(parts):
                    rows.append((page, url, copy, k, len(parts), bytes(view[lo:hi]), digests[k], len(view), digests[-1]))
                    held += hi - lo
                    if held >= _BATCH_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)

    arrow_rows(pages.sparkSession, 256)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.monotonically_increasing_id().alias("copy"), _binary(payload).alias("payload"))
    return src.mapInArrow(run, CHUNKS)


def duplicates(pages: DataFrame, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(payload_digest, payload_bytes, response): the largest page_id of each payload of at
    least ``min_bytes`` that several rows share. Counted before the shuffle, so one
    payload with most rows is a few rows there."""
    d = payload_digests(pages, payload).filter(F.col("payload_bytes") >= min_bytes)
    return (d.groupBy("payload_digest", "payload_bytes")
            .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").drop("n")
            .withColumnsRenamed({"payload_digest": "__digest", "payload_bytes": "__bytes"}))


def _line(name: str, value) -> Column:
    return F.concat(F.lit(CRLF + name + ": "), value if isinstance(value, Column) else F.lit(value))


def write_warc(pages: DataFrame, path: str, payload: str = "html", min_bytes: int = 0,
               chunk_bytes: int = CHUNK_BYTES, date: dt.datetime | None = None) -> None:
    """Write one record per row of ``pages`` (page_id, url, payload) as gzip WARC files.

    Of rows with equal payloads of at least ``min_bytes``, that with the largest page_id
    is a response and the others are revisit records without a block; rows that repeat
    the largest page_id are responses too. A null page_id is written as ``null`` and
    counts as the smallest. Control characters in a url, and the version text, are
    percent-encoded. ``date`` (UTC) is every record's date, by default the time of the call.
    """
    stamp = (date or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    dup = small(materialize(duplicates(pages, payload, min_bytes), "warc-duplicates"))
    rows = chunk_table(pages, payload, chunk_bytes)
    rows = rows.join(dup, (F.col("payload_digest") == F.col("__digest"))
                     & (F.col("payload_bytes") == F.col("__bytes")), "left")
    # A group of null page_ids alone has no largest: each is a response.
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = rows.withColumn("revisit", revisit).filter(~F.col("revisit") | (F.col("chunk") == 0))
    data = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("data"))
    url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20"), VERSION, "WARC%2F1.1")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    origin = F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("copy").cast("string"))
    number = (F.col("chunk") + 1).cast("string")
    split = (F.col("chunks") > 1) & ~F.col("revisit")
    kind = (F.when(F.col("revisit"), F.lit("revisit")).when(F.col("chunk") > 0, F.lit("continuation"))
            .otherwise(F.lit("response")))
    empty = F.lit("")
    head = F.concat(
        F.lit(VERSION), _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(origin, F.when(split, F.concat(F.lit(":"), number)).otherwise(empty), F.lit(">"))),
        _line("WARC-Date", stamp),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", url)).otherwise(empty),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(
            _line("WARC-Profile", REVISIT_PROFILE),
            _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">")))))
         .otherwise(empty),
        F.when(split, F.concat(
            _line("WARC-Segment-Origin-ID", F.concat(origin, F.lit(":1>"))),
            _line("WARC-Segment-Number", number),
            F.when(F.col("chunk") + 1 == F.col("chunks"),
                   _line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"))).otherwise(empty),
            _line("WARC-Segment-Count", F.col("chunks").cast("string")),
            _line("WARC-Prefix-Digest", F.concat(F.lit("sha1:"), F.col("prefix_digest"))))).otherwise(empty),
        _line("Content-Type", "text/html"),
        _line("Content-Length", F.octet_length(data).cast("string")), F.lit(CRLF + CRLF))
    block = F.concat(head.cast("binary"), data, F.lit(CRLF.encode()))
    (rows.select(block.cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", CRLF).option("compression", "gzip").text(path))


RECORDS = ("origin string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, chunks int, chunk int, prefix_digest string, data binary")


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = dict(line.split(": ", 1) for line in head.decode().split(CRLF) if ": " in line)
    n = int(f["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {f.get('WARC-Record-ID')}: block is not {n} bytes")
    f["block"] = rest[:n]
    return f


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record under ``path``. Unsplit records are checked here and come
    without their block; chunks of split records come with it."""
    def run(batches):
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(),
                 pa.int32(), pa.string(), pa.binary()]
        for b in batches:
            rows, held = [], 0
            for v in b.column(0).to_pylist():
                f = _parse(v)
                split = "WARC-Segment-Number" in f
                origin = f["WARC-Segment-Origin-ID" if split else "WARC-Record-ID"]
                page = origin.split(":")[2]
                refers = f.get("WARC-Refers-To")
                n, digest = int(f["WARC-Payload-Length"]), f["WARC-Payload-Digest"][5:]
                if f["WARC-Type"] == "response" and not split and (
                        len(f["block"]) != n or base32_sha1(hashlib.sha1(f["block"])) != digest):
                    raise ValueError(f"record {origin}: payload does not match its digest")
                rows.append((origin, None if page == "null" else int(page), f.get("WARC-Target-URI"),
                             "revisit" if f["WARC-Type"] == "revisit" else "response",
                             int(refers.split(":")[2].rstrip(">")) if refers else None, n, digest,
                             int(f.get("WARC-Segment-Count", 1)), int(f.get("WARC-Segment-Number", 1)) - 1,
                             f["WARC-Prefix-Digest"][5:] if split else None, f["block"] if split else None))
                held += len(rows[-1][-1] or b"")
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    arrow_rows(spark, 256)
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path)
    return (raw.filter(F.octet_length("value") > 0).select(F.col("value").cast("binary"))
            .mapInArrow(run, RECORDS))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record under ``path``: the chunks of a record are dealt to one task
    in order and streamed through a running digest, one chunk in memory at a time."""
    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunks"]
        state = None                                     # (origin, next chunk, bytes, sha1)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["chunks"] > 1:
                    if state is None:
                        state = (r["origin"], 0, 0, hashlib.sha1())
                    origin, nxt, size, h = state
                    h.update(r["data"])
                    if (origin, nxt) != (r["origin"], r["chunk"]) or base32_sha1(h) != r["prefix_digest"]:
                        raise ValueError(f"record {r['origin']}: chunk {r['chunk']} does not follow")
                    state = (origin, nxt + 1, size + len(r["data"]), h)
                    if nxt + 1 < r["chunks"]:
                        continue
                    if size + len(r["data"]) != r["payload_bytes"] or base32_sha1(h) != r["payload_digest"]:
                        raise ValueError(f"record {origin}: payload does not match its digest")
                elif state is not None:
                    raise ValueError(f"record {state[0]}: chunks are missing")
                state = None
                out.append([r[c] for c in names])
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if state is not None:
            raise ValueError(f"record {state[0]}: chunks are missing")

    dealt = read_chunks(spark, path).repartition("origin").sortWithinPartitions("origin", "chunk")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long, chunks int")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC archives and read back; one row per page."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS response FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = response OR response IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM g
"""
