"""Legacy archive conversion: ARC files to WARC records, written and read back.

:func:`convert` parses ARC archives (the columns of Spark's ``binaryFile``):
the version block says whether URL records have the five fields of version 1 or
the ten of version 2, and the declared length says where a record ends, so
payloads may hold anything.  It synthesises record id, date, type and payload
digest.  :func:`with_types` makes equal payloads revisits of one response,
:func:`write_warc` writes gzip files of bounded size through Spark's text
writer, and :func:`read_warc` parses them by their declared lengths.

Defined results: null html is an empty payload; a null url becomes ``unknown:``.
Of equal payloads of at least ``SMALL`` bytes the largest page_id is the
response (null ids only where all are null); rows repeating page_id and payload
are responses alike.  Smaller payloads are all responses.  Payloads and digests
are of the whole page, of any length.  An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm.base import landed, register
from insight.llm.words import text_slices
from insight.session import scratch_path

#: payloads below this many bytes are never revisits
SMALL = 1000
#: records in one WARC file at most, which bounds what a reader holds
FILE_RECORDS = 2000
#: capture time written for pages, which have none
CAPTURED = "20200101000000"
FIELDS_V1 = ["url", "ip", "date", "type", "length"]
FIELDS_V2 = ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"]
PAGE_ID = "X-Page-Id"


# --- legacy archives of the pages

def arc_of_pages(pages: DataFrame) -> DataFrame:
    """(path, content): the pages as ARC archives of about 2 MB, of version 1 and 2 in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in text_slices(batch, "html"):
                version = 1 + n % 2
                name = f"pages-{task}-{n}.arc"  # record ids are made of it: no two tasks share one
                blob = [arc_header(name, version)]
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    blob.append(arc_record(page_id, url, (html or "").encode(), name, version))
                n += 1
                yield pa.record_batch([pa.array([name]), pa.array([b"".join(blob)], pa.binary())], names=["path", "content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string, content binary")


def arc_header(name: str, version: int) -> bytes:
    fields = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 pages\n{fields[version]}\n".encode()
    more = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(page_id: int | None, url: str | None, payload: bytes, name: str, version: int) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + \
        (f"{PAGE_ID}: {page_id}\r\n" if page_id is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    uri = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:")
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{uri} 0.0.0.0 {CAPTURED} text/html{more} {len(block)}\n".encode() + block + b"\n"


# --- conversion

def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(URL record fields, block) of each document of an ARC archive."""
    at, fields = 0, FIELDS_V1
    while at < len(content):
        if content[at:at + 1] == b"\n":  # records are set apart by line ends
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if line.startswith("filedesc:"):
            size = int(parts[-1])
            version = content[end + 1:end + 2]
            if version not in (b"1", b"2"):
                raise ValueError(f"unknown version of the archive: {line}")
            fields = FIELDS_V1 if version == b"1" else FIELDS_V2
        else:
            if len(parts) != len(fields):
                raise ValueError(f"record line of {len(parts)} fields where {len(fields)} are declared: {line[:200]}")
            size = int(parts[-1])
            if end + 1 + size > len(content):
                raise ValueError(f"record is cut off: {line[:200]}")
            yield dict(zip(fields, parts, strict=True)), content[end + 1:end + 1 + size]
        at = end + 1 + size


def warc_date(arc_date: str) -> str:
    """``yyyymmddhhmmss`` (shorter ones padded) as ISO 8601."""
    d = (arc_date + "00000101000000"[len(arc_date):])[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[str, bytes]:
    """HTTP header and payload of a block; a block without header is payload as a whole."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[:end].decode("latin-1"), block[end + 4:]
    return "", block


RECORD = ("page_id long, record_id string, uri string, ip string, date string, content_type string, "
          "payload_bytes long, payload_digest string, digest_label string")


def convert(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """One row for each record of the ARC archives (path, content); ``blocks`` False leaves the block out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                if data[:2] == b"\x1f\x8b":
                    data = gunzip(data)
                rows: list[list] = [[] for _ in range(10)]
                held = 0
                for k, (f, block) in enumerate(parse_arc(data)):
                    http, payload = split_http(block)
                    page = re.search(rf"(?mi)^{PAGE_ID}: (-?\d+)\s*$", http)
                    digest = hashlib.sha1(payload).digest()
                    sha1, label = digest.hex(), "sha1:" + base64.b32encode(digest).decode()
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{f['url']}|{f['date']}|{page and page[1]}|{sha1}|{path}|{k}")
                    for column, value in zip(rows, (
                            int(page[1]) if page else None, f"urn:uuid:{name}", f["url"], f["ip"], warc_date(f["date"]),
                            f["type"], len(payload), sha1, label, block if blocks else None), strict=True):
                        column.append(value)
                    held += len(block)
                    if held > 4 << 20 and blocks:
                        yield batch_of(rows, blocks)
                        rows, held = [[] for _ in range(10)], 0
                yield batch_of(rows, blocks)

    def batch_of(rows: list[list], blocks: bool) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split(" ")[0] for x in RECORD.split(", ")] + ["block"]
        n = 10 if blocks else 9
        return pa.record_batch([pa.array(v, t) for v, t in zip(rows[:n], kinds[:n], strict=True)], names=names[:n])

    return archives.select("path", "content").mapInArrow(run, RECORD + ", block binary" * blocks)


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; one that is cut off is an error."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        if not d.eof:
            raise ValueError("a member of the gzip file is cut off")
        data = d.unused_data
    return b"".join(out)


def with_types(records: DataFrame, index: DataFrame, small: int = SMALL) -> DataFrame:
    """Records with record_type, refers_to (page_id) and refers_to_record.

    ``index`` holds the same records without blocks: equal payloads are found on
    it, reduced to one row a digest before the shuffle.
    """
    big = index.filter(F.col("payload_bytes") >= small)
    holders = big.groupBy("payload_digest").agg(
        F.max(F.coalesce("page_id", F.lit(-2**63))).alias("holder"),
        F.max_by("record_id", F.coalesce("page_id", F.lit(-2**63))).alias("holder_record"),
        F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    holders = landed(holders, "warc-holders")
    joined = records.join(holders, "payload_digest", "left")
    revisit = F.col("holder").isNotNull() & (F.col("payload_bytes") >= small) \
        & (F.coalesce("page_id", F.lit(-2**63)) < F.col("holder"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(revisit, F.col("holder"))) \
        .withColumn("refers_to_record", F.when(revisit, F.col("holder_record"))).drop("holder", "holder_record")


# --- WARC files

def write_warc(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write the records below ``path`` as gzip WARC files.

    A record ends in two line ends, which the text writer adds.  Revisits carry
    the HTTP header only, and the digest and length of the full payload.
    """
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.expr("substring(block, 1, octet_length(block) - cast(payload_bytes as int))")) \
        .otherwise(F.col("block"))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))

    more = F.when(revisit, F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("WARC-Refers-To: <"), F.col("refers_to_record"), F.lit(">\r\n"),
        line("X-Refers-To-Page-Id", F.col("refers_to")))).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("record_type")),
        F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">\r\n"),
        line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.col("date")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.col("digest_label")), more,
        line("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"))
    rows = records.withColumn("out", block).select(F.concat(
        header, line("Content-Length", F.octet_length("out")), F.lit("\r\n"), F.col("out").cast("string")).alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip") \
        .option("maxRecordsPerFile", file_records).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield warc_rows(gunzip(content.as_buffer().to_pybytes()))

    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, uri string, date string")


def warc_rows(data: bytes) -> pa.RecordBatch:
    rows: list[list] = [[] for _ in range(8)]
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:80]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4:end + 4 + size]
        http, payload = split_http(block)
        page = re.search(rf"(?mi)^{PAGE_ID}: (-?\d+)\s*$", http)
        declared = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != declared:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
        refers = head.get("X-Refers-To-Page-Id")
        for column, value in zip(rows, (
                int(page[1]) if page else None,
                len(payload) if head["WARC-Type"] == "response" else int(head["X-Payload-Length"]), declared,
                head["WARC-Type"], int(refers) if refers else None, head["WARC-Record-ID"].strip("<>"),
                head["WARC-Target-URI"], head["WARC-Date"]), strict=True):
            column.append(value)
        at = end + 4 + size + 4
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)],
                           names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                  "record_id", "uri", "date"])


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload_digest)
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload_digest)
            THEN max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
FROM p
"""


@register("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = arc_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    path = scratch_path(spark, "warc")
    write_warc(with_types(convert(archives), convert(archives, blocks=False)), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
