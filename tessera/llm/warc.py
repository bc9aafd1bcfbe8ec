"""Legacy archive converter: ARC records to equivalent WARC records, archives written and read by Spark.

An ARC file is a version block followed by records: a header line whose fields depend on the version,
then as many bytes as the line declares. Conversion keeps the payload and synthesises what
ARC lacks: record ids, ISO timestamps, record types and payload digests.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Field names of an ARC header line by version; fixed by the format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Name space of synthesised record ids.
IDS = uuid.uuid5(uuid.NAMESPACE_URL, "tessera:arc-to-warc")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = b"\r\n\r\n"
#: An ARC archive made from rows is closed beyond so many bytes.
ARCHIVE_BYTES = 4 << 20
#: A WARC file is closed beyond so many compressed bytes.
FILE_BYTES = 32 << 20


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    content: bytes


def arc_date(when: str) -> str:
    """ISO time of an ARC date of 14 digits, or of the first 8 to 12 of them; the epoch if it is none."""
    digits = when if when.isascii() and when.isdigit() and 8 <= len(when) <= 14 else ""
    try:
        return dt.datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(name: str, records: list[tuple[str, str, str, str, bytes]], version: int = 1) -> bytes:
    """An uncompressed ARC file of (url, ip, date, mime, content)."""
    blank = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 tessera\n{blank[version]}\n".encode()
    head = {1: f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 19960101000000 text/plain 200 - - 0 {name} {len(body)}\n"}
    out = io.BytesIO()
    out.write(head[version].encode() + body + b"\n")
    for url, ip, date, mime, content in records:
        url = "".join("%%%02X" % b if b <= 32 or b == 127 else chr(b) for b in url.encode("latin-1", "ignore")) if url.isascii() else "".join(
            chr(b) if 32 < b < 127 else "%%%02X" % b for b in url.encode("utf-8", "replace")
        )
        middle = "" if version == 1 else f" 200 - - {out.tell()} {name}"
        out.write(f"{url or '-'} {ip} {date} {mime}{middle} {len(content)}\n".encode() + content + b"\n")
    return out.getvalue()


def read_arc(source: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file, without its version block; ValueError where lines or lengths don't fit.

    The version comes from the first line of the version block. A url may hold spaces: the other fields
    are counted from the end of the line.
    """
    version, at = None, 0
    while line := source.readline():
        if not line.strip():
            at += len(line)
            continue
        if version is None:
            parts = line.split()
            if not line.startswith(b"filedesc://") or not parts[-1].isdigit():
                raise ValueError("an ARC file begins with a filedesc line")
            block = source.read(int(parts[-1]))
            version = int(block.split(b" ", 1)[0] or 0)
            if len(block) != int(parts[-1]) or version not in ARC_FIELDS:
                raise ValueError(f"broken version block or unknown ARC version {version}")
            at += len(line) + len(block)
            continue
        names = ARC_FIELDS[version]
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"broken ARC header at byte {at}")
        content = source.read(int(parts[-1]))
        if len(content) != int(parts[-1]):
            raise ValueError(f"the ARC record at byte {at} is cut off")
        yield ArcRecord(at, dict(zip(names, parts)), content)
        at += len(line) + len(content)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; content that has no HTTP head is all payload."""
    if content.startswith(b"HTTP/"):
        head, gap, payload = content.partition(b"\r\n\r\n")
        if gap:
            return head + gap, payload
    return b"", content


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def as_text(s: str | None) -> int | None:
    return int(s) if s and s.lstrip("-").isdigit() else None


def warc_record(kind: str, record_id: str, date: str, block: bytes, mime: str, more: dict[str, str | None]) -> bytes:
    """A WARC/1.1 record without the blank lines that end it."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date} | {k: v for k, v in more.items() if v}
    fields |= {"Content-Type": mime, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def read_warc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by declared length; ValueError where the file is broken."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record was expected, not {line[:40]!r}")
        fields = {}
        while (line := source.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = source.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a WARC record is cut off")
        yield fields, block


def arcs_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> DataFrame:
    """(path, content): ARC archives of bounded size, one record per row, the html as UTF-8 payload of an HTTP response.

    A null html is an empty payload, a null url is `-`; the id travels as the HTTP field X-Page-Id, which a null id lacks.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            records, size = [], 0
            for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                payload = html or b""
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                records.append((url or "", "0.0.0.0", "19960101000000", "text/html", head.encode() + payload))
                size += len(payload)
                if size > ARCHIVE_BYTES:
                    yield _archive(records, version, part, number)
                    records, size, number = [], 0, number + 1
            if records:
                yield _archive(records, version, part, number)
                number += 1

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("binary"))
    return rows.mapInArrow(apply, "path string, content binary")


def _archive(records: list, version: int, part: int, number: int) -> pa.RecordBatch:
    """Named after partition and number, so that a repeated task makes the same archives and no two are alike."""
    name = f"pages-{part:06d}-{number:06d}.arc"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(name, records, version)], pa.binary())], names=["path", "content"])


def convert(arcs: DataFrame) -> DataFrame:
    """ARC archives (path, content; as binaryFile reads them, gzipped or not) -> one row for each record.

    record_id is a name-based UUID of archive name, offset and content, so that a repeated task makes the
    same ids. payload is what follows the HTTP head; payload_digest its base32 SHA-1.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                source = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                out, size = [], 0
                for r in read_arc(source):
                    head, payload = split_http(r.content)
                    digest = base32_sha1(payload)
                    rid = uuid.uuid5(IDS, f"{name} {r.offset} {http_field(head, 'x-page-id')} {digest}")
                    out.append((str(rid), as_text(http_field(head, "x-page-id")), r.fields["url"], r.fields["ip"], arc_date(r.fields["date"]), digest, len(payload), head, payload))
                    size += len(payload)
                    if size > ARCHIVE_BYTES:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return arcs.select("path", "content").mapInArrow(
        apply, "record_id string, page_id long, url string, ip string, date string, payload_digest string, payload_bytes long, head binary, payload binary"
    )


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = ["record_id", "page_id", "url", "ip", "date", "payload_digest", "payload_bytes", "head", "payload"]


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def write_warcs(records: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes converted records as WARC files under path, a gzip member for each record, a file closed beyond file_bytes.

    Of records with equal payloads of at least min_bytes, the one with the largest page id (then record id) is
    the response; the others become revisits, which keep the HTTP head but not the payload. Keepers are found by partial
    aggregation over digests; only those of digests that occur twice are joined back. Spark's own
    text writer puts down the bytes, one row a file, so that commits and retries are Spark's; the line separator it adds is an empty gzip
    member, which ends a file. The records are written once first, as both steps read them.
    """
    records = written(records, "converted")
    same = records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "record_id", "url", "date")).alias("keeper"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")
    rows = records.join(written(same, "keepers"), "payload_digest", "left").select(
        *[c for c in records.columns if c != "payload"],
        F.when(F.col("keeper").isNull() | (F.col("keeper.record_id") == F.col("record_id")), F.col("payload")).alias("payload"),
        F.when(F.col("keeper.record_id") != F.col("record_id"), F.col("keeper")).alias("keeper"),
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        add = lambda record: out.append(gzip.compress(record + SEPARATOR, 6, mtime=0))
        for b in batches:
            for r in b.to_pylist():
                if not out:
                    info = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
                    add(warc_record("warcinfo", str(uuid.uuid5(IDS, "info " + r["record_id"])), r["date"], info, "application/warc-fields", {}))
                mime = "application/http; msgtype=response" if r["head"] else "application/octet-stream"
                more = {"WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": "sha1:" + r["payload_digest"]}
                if r["keeper"] is None:
                    add(warc_record("response", r["record_id"], r["date"], r["head"] + r["payload"], mime, more))
                else:
                    k = r["keeper"]
                    more |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{k['record_id']}>", "WARC-Refers-To-Target-URI": k["url"], "WARC-Refers-To-Date": k["date"]}
                    add(warc_record("revisit", r["record_id"], r["date"], r["head"], mime, more))
                size += len(out[-1])
                if size > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["file"])
                    out.clear()
                    size = 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["file"])

    files = rows.mapInArrow(apply, "file binary").select(F.col("file").cast("string"))
    options = {"lineSep": gzip.compress(b"", mtime=0).decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": 1, "compression": "none"}
    files.write.options(**options).text(path)


def read_warcs(spark, path: str) -> DataFrame:
    """One row for each response and revisit in the WARC files under path: ids, url, type, payload digest and size.

    The digest of a response is taken from the payload itself and must equal the declared one. A revisit has its
    declared digest, and the size that its HTTP head declares.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to_record"]
        for b in batches:
            for content in b.column(0).to_pylist():
                out = []
                for f, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload)
                    if f["warc-type"] == "revisit":
                        size = as_text(http_field(head, "content-length"))
                    elif base32_sha1(payload) != digest:
                        raise ValueError(f"{f['warc-record-id']}: the payload does not fit its digest")
                    ids = [x[10:-1] if x else None for x in (f["warc-record-id"], f.get("warc-refers-to"))]
                    out.append((ids[0], as_text(http_field(head, "x-page-id")), f.get("warc-target-uri"), f["warc-type"], digest, size, ids[1]))
                if out:
                    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(
        apply, "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to_record string"
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0, version: int = 1, path: str | None = None) -> DataFrame:
    """Pages -> ARC archives -> WARC files -> what a reader finds in them, one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (page id of the response that a revisit
    refers to), url. Null html: an empty payload, which is deduplicated like any other from min_bytes 0 on.
    Pages with repeated ids and equal payloads: one response, the others revisit it. A null id is returned as null and
    ranks below all others. Other columns are ignored. No pages give no rows.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warcs(convert(arcs_of_pages(pages, version=version)), path, min_bytes)
    found = written(read_warcs(spark, path), "records")
    targets = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    # Responses refer to nothing and stay out of the join, in which their nulls would be one key.
    revisits = found.where("refers_to_record is not null").join(targets, "refers_to_record", "left").select(*columns)
    return found.where("refers_to_record is null").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits)
