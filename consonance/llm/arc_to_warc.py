"""Legacy archive converter: ARC files to WARC files with identical-payload revisits, and a WARC reader.

ARC (the format before WARC) is a run of records: one header line whose fields
depend on the file's version, a declared length, that many bytes, a newline.
The first record (``filedesc:``) names the version and the field list:

* version 1: URL IP-address Archive-date Content-type Archive-length
* version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The converter synthesises what WARC asks for and ARC lacks: a record id (a
name-based UUID of archive and offset, so a rerun gives the same ids), the
14-digit date as an ISO 8601 timestamp, the record type (``warcinfo`` for the
version block, ``response`` for HTTP messages, ``resource`` for the rest) and
SHA-1 digests of block and payload. Responses with equal payloads of at least
``min_bytes`` become revisits of the one with the largest key.

How it runs: archives are read with Spark's binaryFile source and written with
its text sink, one archive per row and file, so any store that Spark knows
works; an archive is a few MB (a longer record is an archive of its own). The
choice of the record to keep is a pre-aggregated group over digests, sizes and
keys; payloads are never shuffled by digest, so a payload that a third of all
pages share is no hot key. Decisions are joined to their archive.

Defined cases: a null or empty html gives an empty payload (always a response);
a null url is written as ``unknown:``; white space in a url is percent-encoded; a record without key is
the last choice to be referred to; equal keys: the larger record id is kept; a
declared length beyond the end of the file gives a truncated record
(``WARC-Truncated: length``); a header line that does not fit its version
raises ``ValueError`` naming the offset; extra columns are ignored; an empty
table gives empty results.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import only, table, written

NAME = "op1_arc_to_warc"
#: bytes of an archive before compression
ARCHIVE_BYTES = 8 << 20
#: zlib level of archives: a third of the default's time for files that are a twentieth larger
GZIP_LEVEL = "THREE"
#: payloads below this size are never revisits
MIN_BYTES = 1000
#: the HTTP header that holds a record's key
KEY_HEADER = "X-Page-Id"

# fixed values of the ARC format: version -> field names of a record's header line
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# --- archives as files: one archive per row -------------------------------------------------

def write_archives(archives: DataFrame, path: str, last: str) -> None:
    """Write column ``content`` (bytes that end with ``last``) as one gzip file per row."""
    body = F.expr(f"substring(content, 1, octet_length(content) - {len(last)})")
    (archives.select(body.cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("lineSep", last).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (its path) and content (still compressed) of every file below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(
        F.col("path").alias("archive"), "content")


def _gunzip(data: bytes) -> bytes:
    """All gzip members of ``data``."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        out.append(d.flush())
        data = d.unused_data.lstrip(b"\0")
    return b"".join(out)


# --- ARC ------------------------------------------------------------------------------------

@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes
    truncated: bool = False
    head: bytes = b""                    # HTTP header block, with its blank line
    payload: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        if self.fields["URL"].startswith("filedesc:"):
            return "warcinfo"
        return "response" if self.head else "resource"


def _split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    m = re.search(rb"\r?\n\r?\n", block)
    cut = m.end() if m else len(block)
    headers = {}
    for line in block[:cut].decode("latin-1").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    return block[:cut], block[cut:], headers


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of one uncompressed ARC file, the version block first."""
    at, names = 0, ARC_FIELDS[1].split(" ")
    while at < len(data):
        if data[at:at + 1] in b"\r\n":      # separators between records
            at += 1
            continue
        eol = data.find(b"\n", at)
        eol = len(data) if eol < 0 else eol
        line = data[at:eol].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc:")
        want = ARC_FIELDS[1].split(" ") if first else names
        # from the right: legacy urls may hold spaces (the version block itself has version 1 fields in both versions
        # unless its length field is further right)
        parts = line.rsplit(" ", len(want) - 1)
        if first and len(line.split(" ")) == len(ARC_FIELDS[2].split(" ")):
            want = ARC_FIELDS[2].split(" ")
            parts = line.split(" ")
        if len(parts) != len(want) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at offset {at}: {line[:80]!r}")
        size, start = int(parts[-1]), eol + 1
        block = data[start:start + size]
        r = ArcRecord(at, dict(zip(want, parts)), block, len(block) < size)
        if first:
            version = re.match(rb"(\d+)", block)
            lines = block.decode("utf-8", "replace").splitlines()
            names = lines[1].split(" ") if len(lines) > 1 and lines[1].startswith("URL ") else ARC_FIELDS.get(
                int(version[1]) if version else 1, ARC_FIELDS[1]).split(" ")
            r.payload = block
        else:
            r.head, r.payload, r.headers = _split_http(block)
        yield r
        at = start + size


def record_id(archive: str, offset: int) -> str:
    """A stable id: the name-based UUID of the archive's file name and the record's offset."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive.rsplit('/', 1)[-1] + '#' + str(offset))}"


def warc_date(arc_date: str) -> str:
    """A 14-digit (or shorter) ARC date as an ISO 8601 timestamp; the epoch if it is no date."""
    digits = re.match(r"\d*", arc_date)[0][:14]
    if len(digits) >= 4:
        digits = digits + "00000101000000"[len(digits):]
    try:
        return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


# --- WARC -----------------------------------------------------------------------------------

def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(r: ArcRecord, archive: str, refers: dict | None, own_id: str | None = None) -> bytes:
    """One ARC record as WARC; ``refers`` (id, uri, date) makes it a revisit without payload."""
    kind = r.kind
    block = r.block
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else kind}",
             f"WARC-Record-ID: <{own_id or record_id(archive, r.offset)}>", f"WARC-Date: {warc_date(r.fields['Archive-date'])}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {r.fields['URL'].split('://', 1)[-1]}")
        block = b"conversion: ARC version block follows\r\n" + block
        lines.append("Content-Type: application/warc-fields")
    else:
        lines += [f"WARC-Target-URI: {r.fields['URL']}", f"WARC-Payload-Digest: {_digest(r.payload)}"]
        if r.fields.get("IP-address", "0.0.0.0") != "0.0.0.0":
            lines.append(f"WARC-IP-Address: {r.fields['IP-address']}")
        if refers:
            block = r.head
            lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      f"WARC-Refers-To: <{refers['id']}>", f"WARC-Refers-To-Target-URI: {refers['uri']}",
                      f"WARC-Refers-To-Date: {refers['date']}", f"X-Payload-Length: {len(r.payload)}"]
        lines.append("Content-Type: " + ("application/http; msgtype=response" if kind == "response"
                                         else r.fields["Content-type"]))
    if r.truncated:
        lines.append("WARC-Truncated: length")
    lines += [f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of one uncompressed WARC file."""
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":
            at += 2
            continue
        cut = data.find(b"\r\n\r\n", at)
        head = data[at:cut].decode("utf-8", "replace").split("\r\n")
        if cut < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        start, size = cut + 4, int(fields["content-length"])
        yield fields, data[start:start + size]
        at = start + size


# --- the Spark jobs -------------------------------------------------------------------------

_META = "archive string, record_id string, uri string, date string, kind string, key long, bytes long, digest string"


def _meta(key_header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for archive, content in zip(rb.column("archive").to_pylist(), rb.column("content").to_pylist()):
                rows = []
                for r in parse_arc(_gunzip(content)):
                    key = r.headers.get(key_header.lower(), "")
                    rows.append({"archive": archive, "record_id": record_id(archive, r.offset), "uri": r.fields["URL"],
                                 "date": warc_date(r.fields["Archive-date"]), "kind": r.kind,
                                 "key": int(key) if re.fullmatch(r"-?\d+", key) else None, "bytes": len(r.payload),
                                 "digest": hashlib.sha1(r.payload).hexdigest()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                        *[(c, pa.string()) for c in ("archive", "record_id", "uri", "date", "kind")],
                        ("key", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())]))
    return run


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for row in rb.to_pylist():
            refers = {x["record_id"]: x for x in row["revisits"] or []}
            ids = ((r, record_id(row["archive"], r.offset)) for r in parse_arc(_gunzip(row["content"])))
            content = b"".join(warc_record(r, row["archive"], refers.get(i), i) for r, i in ids)
            yield pa.RecordBatch.from_pydict({"content": pa.array([content], pa.binary())})


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES,
            key_header: str = KEY_HEADER) -> None:
    """Convert every ARC file below ``arc_path``; WARC files go to ``warc_path``."""
    arcs = read_archives(spark, arc_path)
    meta = arcs.mapInArrow(_meta(key_header), _META).where(F.col("kind") == "response").where(F.col("bytes") >= min_bytes)
    meta = written(meta, "arc-records")  # read twice below; the archives are parsed once
    best = meta.groupBy("digest", "bytes").agg(
        F.max(F.struct("key", "record_id", "uri", "date")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = meta.join(best, ["digest", "bytes"]).where("record_id <> best.record_id")
    again = again.groupBy(F.col("archive").alias("_archive")).agg(F.collect_list(F.struct(
        "record_id", F.col("best.record_id").alias("id"), F.col("best.uri").alias("uri"),
        F.col("best.date").alias("date"))).alias("revisits"))
    both = arcs.join(again, F.col("archive") == F.col("_archive"), "left").drop("_archive")
    write_archives(both.mapInArrow(_to_warc, "content binary"), warc_path, "\r\n")


_READ = "record_id string, type string, uri string, date string, key long, payload_bytes long, payload_digest string, refers_id string"


def _read(key_header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for content in rb.column("content").to_pylist():
                rows = []
                for f, block in parse_warc(_gunzip(content)):
                    if _digest(block) != f["warc-block-digest"]:
                        raise ValueError(f"block digest of {f['warc-record-id']} does not hold")
                    _, payload, headers = _split_http(block)
                    revisit = f["warc-type"] == "revisit"
                    key = headers.get(key_header.lower(), "")
                    given = f.get("warc-payload-digest")
                    digest = given if revisit and given else _digest(payload)
                    if given and digest != given:
                        raise ValueError(f"payload digest of {f['warc-record-id']} does not hold")
                    rows.append({
                        "record_id": f["warc-record-id"].strip("<>"), "type": f["warc-type"],
                        "uri": f.get("warc-target-uri"), "date": f["warc-date"],
                        "key": int(key) if re.fullmatch(r"-?\d+", key) else None,
                        "payload_bytes": int(f["x-payload-length"]) if revisit else len(payload),
                        "payload_digest": base64.b32decode(digest[5:]).hex(),
                        "refers_id": f["warc-refers-to"].strip("<>") if revisit else None})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                        *[(c, pa.string()) for c in ("record_id", "type", "uri", "date")], ("key", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_id", pa.string())]))
    return run


def read_warc(spark: SparkSession, path: str, key_header: str = KEY_HEADER) -> DataFrame:
    """One row per WARC record below ``path``; digests are checked against the bytes, refers_to is the key referred to."""
    rows = written(read_archives(spark, path).mapInArrow(_read(key_header), _READ), "warc-records")
    kept = rows.where("type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_to"))
    revisits = rows.where("refers_id is not null").join(kept, "refers_id", "left")
    return revisits.unionByName(rows.where("refers_id is null").withColumn("refers_to", F.lit(None).cast("long")))


def _page_archives(archive_bytes: int):
    """Stand-in legacy archives: pages as ARC records, versions 1 and 2 by turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        parts, size = [], 0

        def done() -> pa.RecordBatch:
            version = 1 + (task + seq) % 2
            block = f"{version} 0 crawl\n{ARC_FIELDS[version]}\n".encode()
            name = f"filedesc://pages-{task:06d}-{seq:06d}.arc"
            head = f"{name} 0.0.0.0 20100101000000 text/plain {len(block)}\n".encode()
            lines = [head, block]
            for url, key, body in parts:
                day = datetime.datetime(2010, 1, 1) + datetime.timedelta(seconds=(key or 0) % (1 << 31))
                date = day.strftime("%Y%m%d%H%M%S")
                http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if key is not None:
                    http += f"{KEY_HEADER}: {key}\r\n"
                data = http.encode() + b"\r\n" + body
                extra = "" if version == 1 else " 200 - - 0 -"
                lines += [b"\n", f"{url} 127.0.0.1 {date} text/html{extra} {len(data)}\n".encode(), data]
            return pa.RecordBatch.from_pydict({"content": pa.array([b"".join([*lines, b"\n"])], pa.binary())})

        for rb in batches:
            for key, url, html in zip(*(rb.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = (html or "").encode()
                if parts and size + len(body) > archive_bytes:
                    yield done()
                    parts, size, seq = [], 0, seq + 1
                parts.append((re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:") or
                              "unknown:", key, body))
                size += len(body) + 300
        if parts:
            yield done()
    return run


def pages_as_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as ARC files: the input of the converter."""
    src = only(pages, ["page_id", "url", "html"]).select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    write_archives(src.mapInArrow(_page_archives(archive_bytes), "content binary"), path, "\n")


def archived_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records of the pages read back."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    pages_as_arc(pages, arc, archive_bytes)
    convert(spark, arc, warc)
    return read_warc(spark, warc).where("type <> 'warcinfo'")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives and back."""
    out = archived_pages(table(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest",
                      F.col("type").alias("record_type"), "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""
