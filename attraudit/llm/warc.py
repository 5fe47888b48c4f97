"""Operator 6, WARC: archives written from pages, read back, and assembled by transaction.

Writing: each page gives three WARC/1.1 records, one after the other in one file: a request, a response
(or a revisit) and metadata; request and metadata name the response in WARC-Concurrent-To. Of records with
equal payloads of at least ``LEAST`` bytes, the page with the largest id is the response and the others are
revisits, which bear headers and digest but no payload. Payloads are counted by digest, summed map-side; a
payload shared by a third of all pages is one row to each task. Files are gzip-compressed and written by
Spark's own writer, so that they may lie in any store.

Reading: files are read by Spark, parsed record by record by their Content-Length, and grouped by the
concurrent-to identifier into one nested row per capture. Of several requests (or metadata records) of a
capture, the one with the smallest record id stays; records whose response is missing give a capture
without one.

A null html is an empty payload, a null url is left out, a null page id reads back as null (and is a revisit
if another page has its payload). Repeated rows are captures of their own; of those with the largest id all
are responses. Empty tables give empty results; extra columns are not read.
"""
from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attraudit.llm.common import bounded, stored, text_or_empty

LEAST = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
PAGES_A_FILE = 10_000
BATCH_BYTES = 8 << 20


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines of those pairs whose value isn't null."""
    rows = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v.cast("string"), F.lit(CRLF)) for k, v in pairs]
    return F.concat(*[F.coalesce(r, F.lit("")) for r in rows])


def _record(head: Column, block: Column) -> Column:
    return F.concat(F.lit("WARC/1.1" + CRLF), head, _lines(("Content-Length", F.octet_length(block))), F.lit(CRLF), block)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2020-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write the archives of a page table to a folder."""
    base = pages.select(F.col(page_id).alias("page"), F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]", "_").alias("url"), text_or_empty(html).alias("body"))
    base = base.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body"))
    large = base.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page").alias("last"), F.max_by("url", "page").alias("last_url"), F.count("*").alias("n"))
    shared = bounded(stored(large.where(F.col("n") > 1).drop("n"), "shared_payloads"))
    rows = base.join(shared, ["digest", "bytes"], "left").withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("again", F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last")))

    def name(kind: str) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(kind), F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("row").cast("string")))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("X-Page-ID", F.col("page"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes"))), F.lit(CRLF))
    response = _record(
        _lines(("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), ("WARC-Record-ID", name("response")), *common, ("WARC-Payload-Digest", digest),
               ("WARC-Profile", F.when(F.col("again"), PROFILE)), ("WARC-Refers-To-Target-URI", F.when(F.col("again"), F.col("last_url"))),
               ("X-Refers-To-Page", F.when(F.col("again"), F.col("last"))), ("Content-Type", "application/http;msgtype=response")),
        F.concat(http, F.when(F.col("again"), "").otherwise(F.col("body"))))
    ask = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF))
    request = _record(_lines(("WARC-Type", "request"), ("WARC-Record-ID", name("request")), ("WARC-Concurrent-To", name("response")), *common, ("Content-Type", "application/http;msgtype=request")), ask)
    facts = _lines(("payload-bytes", F.col("bytes")), ("page", F.col("page")))
    metadata = _record(_lines(("WARC-Type", "metadata"), ("WARC-Record-ID", name("metadata")), ("WARC-Concurrent-To", name("response")), *common, ("Content-Type", "application/warc-fields")), facts)
    value = F.concat_ws(CRLF * 2, request, response, metadata)
    rows.select(value.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", PAGES_A_FILE).text(path)


class _Stream(io.RawIOBase):
    """The bytes of gzip members that follow each other, unpacked as they are read."""

    def __init__(self, packed: bytes):
        self.rest, self.z = packed, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self.rest:
            out = self.z.decompress(self.rest, len(buffer))
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0


def _fields(f: io.BufferedIOBase) -> dict[str, str]:
    """Header lines up to the empty one, by lower-case name."""
    out = {}
    while (line := f.readline().rstrip(b"\r\n")):
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def records_of(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a gzip-compressed archive, in order."""
    f = io.BufferedReader(_Stream(packed), 1 << 20)
    while (line := f.readline()):
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no record where one should begin: {line[:40]!r}")
            continue
        head = _fields(f)
        n = int(head["content-length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        yield head, block


RECORD = "record_id string, type string, concurrent_to string, uri string, date string, page string, refers_to_page string, payload_digest string, payload_bytes long, intact boolean, payload binary"
_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])


def _parse(payloads: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for content in b.column(0):
                for head, block in records_of(content.as_py()):
                    kind = head.get("warc-type")
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    body, n, intact = b"", len(block), None
                    if kind in ("response", "revisit"):
                        f = io.BytesIO(block)
                        f.readline()
                        http = _fields(f)
                        body = f.read()
                        n = len(body)
                        if kind == "revisit":
                            n = int(http.get("content-length", n))
                        else:
                            own = hashlib.sha1(body).hexdigest()
                            intact, said = own == said, own
                    rows.append((head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-date"),
                                 head.get("x-page-id"), head.get("x-refers-to-page"), said, n, intact, (body or block) if payloads else None))
                    size += 500 + len(block) * payloads
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    return parse


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in a folder; payloads are left out if not asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse(payloads), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: id, request, response (a response or revisit record) and metadata."""
    whole = F.struct(*[c for c in records.columns])
    own = F.col("type").isin("response", "revisit")
    return records.groupBy(F.when(own, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture")).agg(
        F.min_by(F.when(F.col("type") == "request", whole), F.when(F.col("type") == "request", F.col("record_id"))).alias("request"),
        F.min_by(F.when(own, whole), F.when(own, F.col("record_id"))).alias("response"),
        F.min_by(F.when(F.col("type") == "metadata", whole), F.when(F.col("type") == "metadata", F.col("record_id"))).alias("metadata"),
    )


def report(pages: DataFrame, path: str, **names: str) -> DataFrame:
    """Write the pages' archives and read them back: what became of each page."""
    write(pages, path, **names)
    r = F.col("response")
    return captures(read_records(pages.sparkSession, path, payloads=False)).select(
        r["page"].cast("long").alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"),
        r["type"].alias("record_type"), r["refers_to_page"].cast("long").alias("refers_to"))
