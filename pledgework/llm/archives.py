"""Legacy archive converter: ARC files of version 1 and 2 to WARC 1.1 records, and a reader for those.

An ARC file opens with a version block (filedesc://...) whose first line is an ARC record header and whose
body names the version and the header fields. Each record is one header line of 5 (version 1) or 10
(version 2) fields, of which the last is the declared length, then that many bytes. The converter makes the
WARC fields anew: identifier, time stamp, type, block and payload digests.

Tables: `write_archives` turns pages into ARC blocks, converts them, and writes WARC files with Spark's text
writer (the record end, two line ends, is its line separator); `read_archives` reads those files back.

Of records with equal payloads of at least REVISIT_BYTES bytes, the one with the largest page_id is a
response and the others are revisits of it, without body. Defined cases: null html is an empty payload; a
null url becomes "unknown:"; white space in a url is percent-encoded; a null page_id is never a revisit nor
referred to; rows that repeat the largest page_id are all responses; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, map_slices, scratch_path

REVISIT_BYTES = 1000
#: The copies of one payload are dealt to so many keys.
SALTS = 32
FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")}
#: High half of the identifiers made for pages; the low half is the page's number.
PAGE_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pledgework:page").int >> 64
PAGE_HEADER = b"X-Page-Id"
END = b"\r\n\r\n"
ARCHIVE_DATE = "20240101000000"


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    block: bytes


def arc_file(version: int, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of records (url, ip, date, block)."""
    body = f"{version} 0 legacy\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'type': 'Content-type', 'result': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename', 'length': 'Archive-length'}[f] for f in FIELDS[version])}\n".encode()
    more = " 200 - - 0 legacy.arc" if version == 2 else ""
    out = [f"filedesc://legacy.arc 0.0.0.0 {ARCHIVE_DATE} text/plain{more} {len(body)}\n".encode(), body]
    for url, ip, date, block in records:
        out += [f"\n{url} {ip} {date} text/html{more} {len(block)}\n".encode(), block]
    return b"".join([*out, b"\n"])


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block. Raises ValueError on a header or length that doesn't hold."""
    at, version = 0, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if not version:
            if not line.startswith("filedesc://"):
                raise ValueError(f"no version block at {at}")
            version = int(data[end + 1 : end + 2] or b"0")
            if version not in FIELDS:
                raise ValueError(f"version {version} isn't known")
        names, values = FIELDS[version], line.split(" ")
        if len(values) > len(names):  # spaces in a content type
            k = names.index("type")
            extra = len(values) - len(names)
            values = [*values[:k], " ".join(values[k : k + extra + 1]), *values[k + extra + 1 :]]
        if len(values) != len(names) or not values[-1].isdigit() or end < 0:
            raise ValueError(f"malformed header at {at}: {line[:80]}")
        size = int(values[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at {at} declares {size} bytes, {len(block)} follow")
        at = end + 1 + size
        if not line.startswith("filedesc://"):
            yield ArcRecord(version, dict(zip(names, values)), block)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """14 digits to ISO 8601; shorter stamps are filled up to their first moment."""
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def page_urn(page_id: int) -> str:
    return uuid.UUID(int=PAGE_SPACE << 64 | page_id & (1 << 64) - 1).urn


def urn_page(urn: str) -> int:
    low = uuid.UUID(urn).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def content_urn(record: ArcRecord) -> str:
    """The identifier that any conversion of the same record gives."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{record.fields['url']} {record.fields['date']} {hashlib.sha1(record.block).hexdigest()}").urn


def warc_record(record: ArcRecord, urn: str | None = None, refers_to: str | None = None) -> bytes:
    """The WARC record without its end; of a revisit, the block is the HTTP header alone."""
    head, gap, payload = record.block.partition(END)
    http = record.block.startswith(b"HTTP/")
    payload = payload if http else record.block
    block = head + gap if http and refers_to else b"" if refers_to else record.block
    kind = "revisit" if refers_to else "response" if http else "resource"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn or content_urn(record)}>", f"WARC-Date: {warc_date(record.fields['date'])}", f"WARC-Target-URI: {record.fields['url']}", f"WARC-IP-Address: {record.fields['ip']}"]
    lines += [f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: " + ("application/http; msgtype=response" if http else record.fields["type"]), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record. Raises ValueError on what isn't one."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        start, size = end + 4, int(fields["content-length"])
        if len(data) < start + size + 4 or data[start + size : start + size + 4] != END:
            raise ValueError(f"record at {at} declares {size} bytes and doesn't end there")
        yield fields, data[start : start + size]
        at = start + size + 4


def _page_block(page_id, html: bytes) -> bytes:
    mark = b"" if page_id is None else PAGE_HEADER + b": %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"\r\n" + html


def _page_of(block: bytes) -> int | None:
    m = re.search(rb"\r\n" + PAGE_HEADER + rb": (-?\d+)\r\n", block.partition(END)[0] + b"\r\n")
    return int(m[1]) if m else None


def revisit_targets(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(payload_sha1, target) of the payloads that come more than once: the largest page_id has the response."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    long = pages.select("page_id", body.alias("body")).filter(F.col("page_id").isNotNull() & (F.length("body") >= least))
    return long.groupBy(F.sha1("body").alias("payload_sha1")).agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").drop("n")


def warc_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(value) one WARC record a page, made by way of ARC files of both versions."""
    may = (F.length(F.coalesce("html", F.lit("")).cast("binary")) >= least) & F.col("page_id").isNotNull()
    rest = pages.filter(~may).select("page_id", "url", "html", F.lit(None).cast("long").alias("target"))
    keyed = pages.filter(may).select("page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("payload_sha1"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    targets = revisit_targets(pages, least).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = keyed.join(targets, ["payload_sha1", "salt"], "left").select("page_id", "url", "html", F.when(F.col("target") != F.col("page_id"), F.col("target")).alias("target")).unionByName(rest)

    def make():
        def convert(batch: pa.RecordBatch):
            targets, groups = {1: [], 2: []}, {1: [], 2: []}
            for page_id, url, html, target in zip(*(batch[n].to_pylist() for n in ("page_id", "url", "html", "target"))):
                url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"
                version = 2 if page_id is not None and page_id % 2 else 1
                groups[version].append((url, "0.0.0.0", ARCHIVE_DATE, _page_block(page_id, (html or "").encode())))
                targets[version].append(target)
            out = []
            for version, records in groups.items():
                for record, target in zip(read_arc(arc_file(version, records)), targets[version], strict=True):
                    page = _page_of(record.block)
                    out.append(warc_record(record, None if page is None else page_urn(page), None if target is None else page_urn(target)).decode())
            return Columns(value=out)

        return convert

    return map_slices(known, make, "value string", 64)


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, records_a_file: int = 500) -> None:
    """WARC files (.gz) under path, of a bounded number of records each."""
    warc_records(pages, least).write.option("lineSep", END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_a_file).text(path)


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; archives often have one a record."""
    out, rest = [], memoryview(data)
    while len(rest):
        member = zlib.decompressobj(31)
        out.append(member.decompress(rest) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        rest = memoryview(member.unused_data)
    return b"".join(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def make():
        def parse(batch: pa.RecordBatch):
            out = Columns(page_id=[], payload_bytes=[], payload_digest=[], record_type=[], refers_to=[])
            for content in batch["content"]:
                for fields, block in read_warc(gunzip(content.as_buffer())):
                    payload = block.partition(END)[2]
                    named = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).digest() != named:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    out["page_id"].append(_page_of(block))
                    out["payload_bytes"].append(int(fields["x-payload-length"]) if revisit else len(payload))
                    out["payload_digest"].append(named.hex())
                    out["record_type"].append(fields["warc-type"])
                    out["refers_to"].append(urn_page(fields["warc-refers-to"].strip("<>")) if revisit else None)
            return out

        return parse

    return map_slices(files, make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", 1)


def archive_round_trip(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)


#: The same rows in DuckDB's SQL.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM {pages}),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN t.target > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN t.target > d.page_id THEN t.target END AS refers_to
FROM d LEFT JOIN t ON d.payload_digest = t.payload_digest AND d.payload_bytes >= 1000
"""
