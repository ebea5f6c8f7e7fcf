"""WARC archives: written from pages, read back, and assembled into one row per capture.

Each page gives a request, a response (or a revisit, where a payload repeats) and a metadata record, tied to
the response by WARC-Concurrent-To. Every record is a gzip member of its own, as WARC tools expect, so one can be
read at its place without the others. Members are packed into files of ``ARCHIVE`` bytes at most; only a single
larger record makes a larger one. Files are written by Spark's text sink, a row each, so a failed task leaves
nothing behind; the sink's line end is one zero byte, which gzip readers skip as padding. Reading streams through
the members of a file and holds one record at a time. Parsing goes by Content-Length.

Of rows with equal payloads of at least LEAST bytes, that with the largest page_id is the response, the
others revisit it. Only the digests that occur twice are looked up, and payloads stay out of that.

Defined results: a null html is an empty payload, a null url an empty target; rows with a repeated page_id
are captures of their own, numbered; rows without page_id are never preferred as response unless no other
has the payload. An empty table gives no archive and no capture. Payloads are never cut. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, new_path, remove, table
from slideqa.llm.text import lean

LEAST = 1000
#: Bytes of a file: it is read in one task, as one value.
ARCHIVE = 16 << 20
#: Bytes that a gzip member is fed at a time: what lies behind its end is copied.
STEP = 1 << 15
#: Bytes of payloads that leave a task at a time.
BATCH = 1 << 23
DATE = "2024-01-01T00:00:00Z"
#: Rows up to which the repeated digests are broadcast: about 70 MB.
BROADCAST_ROWS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, kind string, concurrent_to string, refers_to string, target string, digest string, page_id long, payload binary"


def _urn(*parts: Column | str) -> Column:
    """A record id made of its parts."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, name: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """A record without the blank lines that end it."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {DATE}")]
    for key, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{key}: "), value)).otherwise(""))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def _numbered(pages: DataFrame) -> DataFrame:
    """Adds ``copy``, 0 unless the page_id is repeated."""
    again = pages.groupBy("page_id").count().where("count > 1").select("page_id")
    if again.isEmpty():
        return pages.withColumn("copy", F.lit(0))
    again = again.withColumn("again", F.lit(True)).withColumnRenamed("page_id", "other")
    both = pages.join(again, F.col("page_id").eqNullSafe(F.col("other")), "left").drop("other")
    once = both.where("again is null").drop("again").withColumn("copy", F.lit(0))
    twice = both.where("again").drop("again").selectExpr("*", "cast(row_number() over (partition by page_id, xxhash64(digest, url) % 64 order by digest, url) - 1 as int) * 64 + cast(pmod(xxhash64(digest, url), 64) as int) + 1 as copy")
    return once.unionByName(twice)


def _archives(limit: int):
    """Records to archives: members of gzip one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                packer = zlib.compressobj(wbits=31)
                member = packer.compress(record.as_buffer()) + packer.compress(b"\r\n\r\n") + packer.flush()
                if members and size + len(member) > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])
                    members, size = [], 0
                members.append(member)
                size += len(member)
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, archive: int = ARCHIVE) -> None:
    """Writes the pages as WARC files under path."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]", "%0A")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = _numbered(rows)
    # where the winner's page_id is repeated, revisits name the record of its first copy
    copies = rows.where("copy > 0").select("digest", F.col("page_id").alias("original"), "copy").join(repeated, ["digest", "original"]).groupBy("digest").agg(F.min("copy").alias("first"))
    repeated = repeated.join(copies, "digest", "left").withColumn("first", F.coalesce("first", F.lit(0)))
    rows = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    # copies of the winner are responses like it
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    main = _urn("response", page, F.col("copy").cast("string"))
    target, digest = F.col("url"), F.concat(F.lit("sha1:"), F.col("digest"))
    concurrent = ("WARC-Concurrent-To", main)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), main,
        [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("original").cast("string"), F.col("first").cast("string")))), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record("request", _urn("request", page, F.col("copy").cast("string")), [("WARC-Target-URI", target), concurrent, ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    about = F.concat(F.lit("page-id: "), page, F.lit("\r\npayload-bytes: "), F.octet_length("html").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", _urn("metadata", page, F.col("copy").cast("string")), [("WARC-Target-URI", target), concurrent, ("Content-Type", F.lit("application/warc-fields"))], about)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("record")).select(F.col("record").cast("binary"))
    files = records.mapInArrow(lean(_archives(archive)), "archive binary")
    files.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(data: memoryview) -> Iterator[bytes]:
    """The contents of gzip members one after another; zero bytes between and behind them are padding."""
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        part, out = zlib.decompressobj(wbits=31), []
        while not part.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            step = data[at : at + STEP]
            out.append(part.decompress(step))
            at += len(step) - len(part.unused_data)
        yield b"".join(out)


def records(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and body of each record; a member may hold several."""
    for member in members(data):
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            size = int(headers["content-length"])
            yield headers, member[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for h, body in records(memoryview(content.as_buffer())):
                kind, payload, page = h["warc-type"], None, None
                if kind == "response":
                    payload = body[body.index(b"\r\n\r\n") + 4 :]
                elif kind == "metadata":
                    fields = dict(x.split(": ", 1) for x in body.decode().split("\r\n") if ": " in x)
                    page = int(fields["page-id"]) if fields["page-id"] else None
                rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, page, payload))
                size += len(payload or b"")
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; payload: the body of a response behind its HTTP headers."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(_parsed), _RECORD)


def captures(records: DataFrame, payload: bool = True) -> DataFrame:
    """One row per capture: page_id, target, request, metadata and response (structs; the payload only if
    wanted), payload_bytes, payload_digest (both of the full payload), record_type and refers_to (page_id)."""
    records = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_sha1", F.sha1("payload"))
    if not payload:
        # three joins read the records: without payloads they are few bytes, and archives are read once
        records = Saved(records.drop("payload"), "records").df
    main = records.where("kind in ('response', 'revisit')").select("record_id", "kind", "target", "refers_to", "digest", "payload_bytes", "payload_sha1", *["payload"][: int(payload)])
    request = records.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target").alias("request"))
    about = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), "page_id", F.struct("record_id", "page_id").alias("metadata"))
    joined = main.join(request, "record_id", "left").join(about, "record_id", "left")
    # a revisit's payload is that of the record it refers to
    wanted = joined.where("kind = 'revisit'").select("refers_to").distinct()
    answers = joined.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), "digest", F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("bytes"), F.col("payload_sha1").alias("sha1"))
    originals = wanted.join(answers, "refers_to").groupBy("refers_to", "digest").agg(F.max("to_page").alias("to_page"), F.max("bytes").alias("bytes"), F.max("sha1").alias("sha1"))
    full = joined.join(originals, ["refers_to", "digest"], "left")
    response = F.struct("record_id", "kind", "digest", "payload_bytes", *["payload"][: int(payload)]).alias("response")
    return full.select("page_id", "target", "request", "metadata", response, F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), F.coalesce("payload_sha1", "sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("to_page").alias("refers_to"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    found = captures(read_warc(spark, path), payload=False)
    remove(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN r ON r.d = p.d AND p.n >= 1000
"""
