"""Operator 4, legacy web archives (ARC) converted to WARC, with revisit records for equal payloads.

`write_arc` and `read_arc` know both versions of the ARC header line; a version block names the fields of the lines
that follow, and declared lengths bound the records. `to_warc` synthesises what ARC lacks: record ids, ISO
timestamps, record types, payload and block digests. Archives are rows of a table in the shared folder, each a
bounded number of gzip members, so that neither driver nor executors keep files of their own.

Null html is the empty payload, and equal to other empty payloads. Among records of equal payloads of at least
`least` bytes the one with the largest page_id is the response; repeated rows of that page_id all are. Records with a
null page_id keep null, and without any other id among equals all are responses. Null urls become `unknown:`. Payloads
of any length are one record each, with their declared length. Ids are texts of any kind: what cannot stand in a header
line (blanks, line breaks, percent signs, other alphabets) is written as %XX there and comes back byte for byte. An empty
table gives no records; further columns may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import encoded, map_slices, project, settle

#: Fields of a header line by ARC version, in the order of the format; fixed values.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes in one archive.
ARCHIVE_BYTES = 2 << 20
#: Rows of equal-payload keys that may be broadcast (some 60 bytes each); with more, a salted join takes over.
BROADCAST_ROWS = 50_000
SALTS = 16


class BadArchive(ValueError):
    """The bytes are not a well-formed archive."""


@dataclass
class Record:
    """An archived response."""

    url: str
    date: str
    head: bytes
    payload: bytes
    ip: str = "0.0.0.0"
    kind: str = "text/html"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _word(text: str | None) -> str:
    """A value without blanks, as header lines need it."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "") or "unknown:"


def write_arc(records: list[Record], version: int = 1, name: str = "archive.arc") -> bytes:
    """An uncompressed ARC file: its version block, then each record's header line and declared bytes."""
    about = f"{version} 0 inkstream\n{ARC_FIELDS[version]}\n"
    lead = f"filedesc://{_word(name)} 0.0.0.0 {records[0].date if records else '19700101000000'} text/plain "
    lead += f"200 - - 0 {_word(name)} " if version == 2 else ""
    out = [f"{lead}{len(about)}\n{about}".encode()]
    at = len(out[0]) + 1
    for r in records:
        body = r.head + r.payload
        middle = f" 200 {hashlib.md5(body).hexdigest()} - {at} {_word(name)}" if version == 2 else ""
        part = f"{_word(r.url)} {r.ip} {r.date} {_word(r.kind)}{middle} {len(body)}\n".encode() + body
        out.append(part)
        at += len(part) + 1
    return b"\n".join(out) + b"\n"


def read_arc(data: bytes) -> Iterator[Record]:
    """Records of an ARC file of either version; raises BadArchive where a line or length does not fit."""
    fields: list[str] = ARC_FIELDS[1].split()
    at, first = 0, True
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise BadArchive("a header line does not end")
        values = data[at:stop].decode().split(" ")
        if first:
            fields = ARC_FIELDS[2 if len(values) == len(ARC_FIELDS[2].split()) else 1].split()
        if len(values) != len(fields) or not values[-1].isdigit():
            raise BadArchive(f"a header line has {len(values)} fields instead of {len(fields)}")
        row = dict(zip(fields, values, strict=True))
        size = int(row["Archive-length"])
        body = data[stop + 1 : stop + 1 + size]
        if len(body) != size:
            raise BadArchive("a record is shorter than it says")
        at = stop + 1 + size
        if first and row["URL"].startswith("filedesc://"):
            lines = body.decode().split("\n")
            if lines[0].split(" ")[0] not in ("1", "2") or lines[1] != ARC_FIELDS[int(lines[0].split(" ")[0])]:
                raise BadArchive("the version block names other fields")
            fields = lines[1].split()
        else:
            cut = body.find(b"\r\n\r\n")
            cut = cut + 4 if body.startswith(b"HTTP/") and cut >= 0 else 0
            yield Record(row["URL"], row["Archive-date"], body[:cut], body[cut:], row["IP-address"], row["Content-type"])
        first = False


def record_id(page: str, digest: str) -> str:
    """The record id of a page's payload; a revisit can name the response's id without having seen it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page} {digest}'.encode()).digest(), version=4)}>"


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def page_of(head: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(b"x-page-id:"):
            return unquote(line[10:].strip().decode())
    return None


def _line(value: str) -> str:
    """A value as it can stand in a header line: blanks, line breaks, percent signs and what is not ASCII as %XX."""
    return quote(value, safe="!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~")


def to_warc(record: Record, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 response or, with the page it refers to, revisit record."""
    digest = base32_sha1(record.payload)
    page = page_of(record.head)
    block = record.head if refers_to is not None else record.head + record.payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(record.url if page is None else page, digest)}",
        f"WARC-Date: {_iso(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Length: {len(record.payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page: {_line(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of uncompressed WARC bytes."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise BadArchive("no WARC record starts here")
        fields = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise BadArchive("a record is shorter than it says")
        yield fields, block
        at = stop + 8 + size


def _with_references(rows: DataFrame, least: int) -> DataFrame:
    """rows (key, url, html) with refers: the key of the response that a row's payload revisits, or null."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("sha", F.unhex(F.sha1(body)))
    big = F.octet_length(body) >= least
    groups = rows.filter(big).groupBy("sha").agg(F.max("key").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "top")
    groups = settle(groups, "equal-payloads")
    if groups.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(groups), "sha", "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    return out.select("key", "url", "html", F.when(big & (F.col("top") != F.col("key")), F.col("top")).alias("refers"))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, version: int = 1, date: str = "20250101000000") -> DataFrame:
    """Gzipped WARC archives of the pages, (name, warc binary), by way of ARC; settled in the shared folder.

    Reads the pages twice; only digests of equal payloads are shuffled, or also the pages where those are many.
    """
    rows = _with_references(project(pages, key=key, url=url, html=html), least)

    def kernel(batch: pa.RecordBatch) -> dict:
        heads, refers = [], batch.column("refers").to_pylist()
        for k, body in zip(batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = f"X-Page-Id: {_line(str(k))}\r\n" if k is not None else ""
            heads.append(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len((body or '').encode())}\r\n\r\n".encode())
        records = [Record(_word(u), date, h, p) for u, h, p in zip(batch.column("url").to_pylist(), heads, encoded(batch.column("html")), strict=True)]
        name = f"{uuid.uuid4().hex}.arc"
        legacy = write_arc(records, version, name)
        members = [
            _member(to_warc(r, None if to is None else str(to)))
            for r, to in zip(read_arc(legacy), refers, strict=True)
        ]
        return {"name": [name[:-4] + ".warc.gz"], "warc": [b"".join(members)]}

    out = map_slices(rows, kernel, "name string, warc binary", text="html", limit=ARCHIVE_BYTES)
    return settle(out, "archives")


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def read_archives(archives: DataFrame, warc: str = "warc") -> DataFrame:
    """A row for each record of gzipped WARC archives, its digests checked against its bytes."""
    rows = project(archives, warc=warc)

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("page", "url", "date", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_id", "block_ok")}
        for data in batch.column("warc").to_pylist():
            for f, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(data)).read()):
                cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                kind = f["warc-type"]
                said = f["warc-payload-digest"].removeprefix("sha1:")
                payload = block[cut:]
                out["page"].append(page_of(block[:cut]))
                out["url"].append(f["warc-target-uri"])
                out["date"].append(f["warc-date"])
                out["record_id"].append(f["warc-record-id"])
                out["record_type"].append(kind)
                out["payload_bytes"].append(len(payload) if kind == "response" else int(f["warc-payload-length"]))
                out["payload_digest"].append(base32_sha1(payload) if kind == "response" else said)
                told = f.get("warc-refers-to-page")
                out["refers_to"].append(told if told is None else unquote(told))
                out["refers_to_id"].append(f.get("warc-refers-to"))
                out["block_ok"].append(f["warc-block-digest"] == f"sha1:{base32_sha1(block)}" and (kind != "response" or base32_sha1(payload) == said))
        return out

    schema = "page string, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, refers_to_id string, block_ok boolean"
    return map_slices(rows, kernel, schema, text="warc")
