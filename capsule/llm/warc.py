"""WARC archives: written in segments, read back and reassembled.

A capture is a response record (HTTP header, chunked body) or, when an earlier capture had the same payload, a revisit
record without a body. A block longer than a segment is cut: the first segment stays in the record, the others follow
as continuation records that name the record they continue, their number and, in the last, the total length.

Writing and reading both go through Spark's own sources: records are lines of the text sink ended by the blank lines
that end a WARC record, in gzip files of a bounded number of records; archives are read as whole files of that bounded
size. Segments are grouped by the record they belong to (a group is one record) and put in order of their number; the
total length is verified and the chunked framing decoded.

Defined cases. Null payload: the empty payload. Null or odd URL: written percent-encoded, null as no header. Equal
payloads of at least `least` bytes: the smallest page_id is the response (nulls last), the others revisit it. Rows that
repeat a page_id and payload are one capture and come out once. Empty table: no archive, empty result. A record that
lacks a segment, whose total length differs, or whose framing is broken has that as its `status` and a null payload.
Other columns of the input are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.llm.common import table
from capsule.sources.staging import shared_folder

SEGMENT = 1 << 15
CHUNK = 1 << 12
#: Records in one archive file; with SEGMENT it bounds a file's size (before compression) to 32 MB.
FILE_RECORDS = 1024
END = "\r\n\r\n"
HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, chunk extensions and trailers left aside; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16) if line >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        at = line + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def record_id(page_id, sha: str, segment: int = 1) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{sha}/{segment}").urn


def record(kind: str, rid: str, block: bytes, **headers) -> bytes:
    """One WARC record without the blank lines after it."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 2000-01-01T00:00:00Z",
             *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + END).encode() + block


def capture(page_id, url, payload: bytes, sha: str, first, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page; `first` is the page it revisits, or itself."""
    rid, uri = record_id(page_id, sha), None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    shared = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{sha}", "X_Page_ID": page_id}
    if first != page_id:
        yield record("revisit", rid, HEADER, Content_Type="application/http; msgtype=response", WARC_Profile=PROFILE,
                     WARC_Refers_To=f"<{record_id(first, sha)}>", X_Refers_To_Page_ID=first, X_Payload_Length=len(payload), **shared)
        return
    block = HEADER + chunked(payload, chunk)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    yield record("response", rid, parts[0], Content_Type="application/http; msgtype=response",
                 WARC_Segment_Number=1 if len(parts) > 1 else None, **shared)
    for n, part in enumerate(parts[1:], 2):
        yield record("continuation", record_id(page_id, sha, n), part, WARC_Segment_Number=n, WARC_Segment_Origin_ID=f"<{rid}>",
                     WARC_Segment_Total_Length=len(block) if n == len(parts) else None)


def first_captures(pages: DataFrame, least: int) -> DataFrame:
    """Rows (sha, first): the page that is the response for each payload of at least `least` bytes. Counted per
    payload before anything wide moves, so frequent payloads cost one row a task."""
    return (pages.where(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("sha"))
            .agg(F.min("page_id").alias("first")))


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Write `pages` (page_id, url, payload) as archives under `path`."""
    keyed = pages.select("page_id", "url", "payload", F.sha1("payload").alias("sha"))
    known = keyed.join(first_captures(pages, least), "sha", "left").drop("sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for page_id, url, payload, first in zip(*(b.slice(at, 64)[c].to_pylist() for c in ("page_id", "url", "payload", "first"))):
                    if len(payload) < least:
                        first = page_id
                    out += capture(page_id, url, payload, digest(payload), first, segment, chunk)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
    (known.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        top = data.find(b"\r\n\r\n", at)
        if top < 0:
            return
        lines = data[at:top].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers.get("content-length", 0))
        yield headers, data[top + 4:top + 4 + length]
        at = data.find(b"WARC/", top + 4 + length)


def inflated(data: bytes) -> bytes:
    """Content of an archive file; gzip members follow one another."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out) if out else data


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, origin, segment, total, kind, page_id, refers_to, sha, length, block) of all archives under `path`."""
    names = ("id", "origin", "segment", "total", "kind", "page_id", "refers_to", "sha", "length", "block")
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def number(h, key):
        return int(h[key]) if h.get(key, "").lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["content"]:
                rows = []
                for h, block in parse(inflated(data.as_py())):
                    rows.append((h.get("warc-record-id"), h.get("warc-segment-origin-id"), number(h, "warc-segment-number"),
                                 number(h, "warc-segment-total-length"), h.get("warc-type"), number(h, "x-page-id"),
                                 number(h, "x-refers-to-page-id"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 number(h, "x-payload-length"), block))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "id string, origin string, segment long, total long, kind string, page_id long, "
                                 "refers_to long, sha string, length long, block binary")


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: those of one segment as they are, the others from their segments. `status` is ok,
    missing_segment or length_mismatch; a segment that comes twice counts once."""
    own = ("kind", "page_id", "refers_to", "sha", "length")
    single = records.where("segment is null").select("id", *own, "block", F.lit("ok").alias("status"))
    first = F.col("segment") == 1
    parts = (records.where("segment is not null")
             .groupBy(F.coalesce("origin", "id").alias("id"))
             .agg(*[F.max(F.when(first, F.col(c))).alias(c) for c in own], F.max("total").alias("total"),
                  F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts")))
    whole = F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), "")
    numbers = F.transform("parts", lambda p: p["segment"])
    parts = parts.withColumn("block", F.unhex(whole)).withColumn(
        "status", F.when(F.col("total").isNull() | (numbers != F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))), "missing_segment")
        .when(F.octet_length("block") != F.col("total"), "length_mismatch").otherwise("ok"))
    return single.unionByName(parts.drop("total", "parts"))


def payloads(whole: DataFrame) -> DataFrame:
    """Rows (id, kind, page_id, refers_to, status, payload, payload_bytes, payload_digest); a revisit has no payload
    of its own, only its length and digest as recorded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for kind, status, block, sha, length in zip(*(part[c].to_pylist() for c in ("kind", "status", "block", "sha", "length"))):
                    if kind == "revisit":
                        out.append((status, None, length, sha))
                        continue
                    head, _, body = (block or b"").partition(b"\r\n\r\n")
                    is_chunked = b"transfer-encoding: chunked" in head.lower()
                    payload = None if status != "ok" else unchunked(body) if is_chunked else body
                    status = "broken_framing" if status == "ok" and payload is None else status
                    out.append((status, payload, None if payload is None else len(payload), None if payload is None else digest(payload)))
                kept = [part[c] for c in ("id", "kind", "page_id", "refers_to")]
                types = (pa.string(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                                                 ["id", "kind", "page_id", "refers_to", "status", "payload", "payload_bytes", "payload_digest"])
    return whole.mapInArrow(run, "id string, kind string, page_id long, refers_to long, status string, payload binary, "
                                 "payload_bytes long, payload_digest string")


def op1_warc_segments(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """Every page written to archives in segments and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write_archives(pages, path, least)
    read = payloads(reassemble(read_records(spark, path)))
    return (read.select("id", "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "status")
            .dropDuplicates(["id"]).drop("id"))
