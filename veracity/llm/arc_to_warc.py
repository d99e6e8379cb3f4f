"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a ``filedesc://`` record whose body names the version and
the fields of the header lines.  Every record is a header line, as many bytes
as the line's last field declares, and a line end:

* version 1: ``URL IP-address Archive-date Content-type Archive-length``
* version 2: ``URL IP-address Archive-date Content-type Result-code Checksum
  Location Offset Filename Archive-length``

The converter takes records by their declared lengths and splits the body
into protocol headers and payload.  It synthesises what WARC asks for: a record
id (a name-based UUID of archive, place and URL, so a repeated task makes the same
one), the date in ISO form, the record type (warcinfo for the file description, response for
HTTP, resource for the rest), content types and the base32 SHA-1 digests of block and payload.  Of records with equal payloads the one
with the smallest page id is the response, the others become revisits of it.
Each record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import read_file, ready, stage, work_path, write_file
from veracity.operators.skew import salted_join

MIN_BYTES = 0
ARCHIVE_RECORDS = 64
SHARD_BYTES = 32 << 20
#: Most bytes of the list of revisits that is sent to all tasks; a longer one meets the records by archive and place.
SENT_BYTES = 32 << 20
# fixed values: header fields of the ARC versions and the WARC profile of revisits
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# end of fixed values
_RECORD = ("archive string, at long, kind string, url string, ip string, date string, mime string, headers binary, payload binary, "
           "page_id long, payload_bytes long, payload_digest string")


@dataclass
class ArcRecord:
    at: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_arc(data: bytes, description: bool = False) -> Iterator[ArcRecord]:
    """The records of an ARC file after its file description, or from it on.

    A malformed version block, a header line with other fields than its
    version's or a length past the end of the file raises ValueError.
    """
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        parts = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        try:
            size = int(parts[-1])
        except ValueError:
            raise ValueError(f"no declared length at byte {at}") from None
        block = data[end + 1:end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        if fields is None:
            version = block.split(b" ", 1)[0]
            if not parts[0].startswith("filedesc://") or not version.isdigit() or int(version) not in ARC_FIELDS:
                raise ValueError("no known version block")
            fields = ARC_FIELDS[int(version)].split(" ")
            if description:
                yield ArcRecord(at, parts[0], parts[1] if len(parts) > 2 else "-", parts[2] if len(parts) > 3 else "", "text/plain", block)
        elif len(parts) != len(fields):
            raise ValueError(f"header line at byte {at} has {len(parts)} fields, not {len(fields)}")
        else:
            own = dict(zip(fields, parts, strict=True))
            yield ArcRecord(at, own["URL"], own["IP-address"], own["Archive-date"], own["Content-type"], block)
        at = end + 1 + size
        while data[at:at + 1] == b"\n":
            at += 1


def iso_date(arc_date: str) -> str:
    """WARC-Date of an ARC date of 14 digits; a shorter one is completed with
    the start of its period, a time there isn't becomes the start of the last period that there is, and
    one without a year the epoch."""
    if not re.fullmatch("[0-9]{4,}", arc_date) or arc_date[:4] == "0000":
        return "1970-01-01T00:00:00Z"
    at = datetime(int(arc_date[:4]), 1, 1)
    for lo, part in zip(range(4, 14, 2), ("month", "day", "hour", "minute", "second")):
        digits = arc_date[lo:lo + 2]
        try:
            at = at.replace(**{part: int(digits)})
        except ValueError:  # no digits left, or no such month, day or time
            break
    return at.strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """(protocol headers with their empty line, payload); no headers if the
    block isn't an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, found, body = block.partition(b"\r\n\r\n")
    return (head + found, body) if found else (block, b"")


def record_kind(r: ArcRecord) -> str:
    """WARC-Type of an ARC record: the file description is a warcinfo, an HTTP
    response a response, anything else (a name look-up, a bare document) a resource."""
    if r.at == 0 and r.url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if r.block.startswith(b"HTTP/") else "resource"


def info_fields(r: ArcRecord) -> bytes:
    """Fields of the warcinfo that stands for a file description."""
    version = r.block.split(b" ", 1)[0].decode()
    return (f"format: WARC File Format 1.1\r\ndescription: converted from {r.url.removeprefix('filedesc://')}, "
            f"an archive of ARC version {version}\r\n").encode()


def header_value(head: bytes, name: str) -> str | None:
    want = name.lower().encode() + b":"
    for line in head.split(b"\r\n")[1:]:
        if line.lower().startswith(want):
            return line[len(want):].strip().decode("utf-8", "replace")
    return None


def _record_id(archive: str, at: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}#{url}')}>"


def warc_record(row: dict, revisit_of: dict | None) -> bytes:
    """A gzip member with the WARC record of a converted row."""
    head, payload, type_ = row["headers"], row["payload"], row.get("kind", "response")
    block = head if revisit_of else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit_of else type_}",
        f"WARC-Record-ID: {_record_id(row['archive'], row['at'], row['url'])}",
        f"WARC-Date: {iso_date(row['date'])}", f"WARC-Target-URI: {row['url']}", f"WARC-IP-Address: {row['ip']}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Identified-Payload-Type: {row['mime']}",
    ]
    if revisit_of:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {revisit_of['id']}",
                  f"WARC-Refers-To-Target-URI: {revisit_of['url']}", f"WARC-Refers-To-Date: {iso_date(revisit_of['date'])}",
                  f"X-Refers-To-Page: {revisit_of['page_id']}"]
    if type_ == "warcinfo":  # describes an archive: no target, no payload of a protocol
        lines = [x for x in lines if not x.startswith(("WARC-Target-URI", "WARC-IP-Address", "WARC-Identified"))] + [f"WARC-Filename: {row['archive']}"]
    kind = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}.get(type_, row["mime"])
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 5, mtime=0)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of a .warc.gz file."""
    view = memoryview(data)
    at = 0
    while at < len(data):
        member, text = zlib.decompressobj(31), []
        while not member.eof:
            part = view[at:at + (1 << 16)]
            if not part:
                raise ValueError("a member is cut off")
            text.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        text = b"".join(text)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        own = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = rest[:int(own["content-length"])]
        if own.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {own.get('warc-record-id')} differs")
        yield own, block


def stand_in_archives(pages: DataFrame, records: int = ARCHIVE_RECORDS) -> DataFrame:
    """(path, content): ARC files that hold the rows of ``pages`` (page_id, url,
    html), of version 1 and 2 in turn; null html is an empty body.  This only
    makes the converter's input; real archives have the same two columns when
    they are read with Spark's ``binaryFile`` source.  The page's id travels as a protocol header."""
    ready(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, records):
                rows, n = batch.slice(at, records).to_pylist(), n + 1
                version = 1 + zlib.crc32(str(rows[0]["page_id"]).encode()) % 2
                name = f"pages-{part}-{n}-{rows[0]['page_id']}-{version}.arc"
                desc = f"{version} 0 stand-in\n{ARC_FIELDS[version]}\n".encode()
                out = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(desc)}\n".encode(), desc, b"\n"]
                place = sum(map(len, out))
                for r in rows:
                    body = r["html"] or b""
                    page = f"X-Page-Id: {r['page_id']}\r\n" if r["page_id"] is not None else ""
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(body)}\r\n\r\n".encode() + body
                    url = "%20".join((r["url"] or "about:blank").split()) or "about:blank"
                    two = f"200 {base32_sha1(body)} - {place} {name} " if version == 2 else ""
                    out.append(f"{url} 0.0.0.0 {20200101000000 + (r['page_id'] or 0) % 28 * 1000000} text/html {two}{len(block)}\n".encode() + block + b"\n")
                    place += len(out[-1])
                yield pa.RecordBatch.from_pylist([{"path": name, "content": b"".join(out)}])

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary").alias("html"))
    return columns.mapInArrow(run, "path string, content binary")


def convert(archives: DataFrame) -> DataFrame:
    """A row for each record of the ARC files (path, content), with digest and size of its payload."""
    ready(archives.sparkSession)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for r in read_arc(content.as_py(), description=True):
                    kind = record_kind(r)
                    head, payload = split_block(r.block) if kind == "response" else (b"", info_fields(r) if kind == "warcinfo" else r.block)
                    page = header_value(head, "X-Page-Id")
                    rows.append({"archive": path.as_py(), "at": r.at, "kind": kind, "url": r.url, "ip": r.ip, "date": r.date, "mime": r.mime,
                                 "headers": head, "payload": payload, "page_id": int(page) if page else None,
                                 "payload_bytes": len(payload), "payload_digest": base32_sha1(payload)})
                    size += len(payload)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return archives.select("path", "content").mapInArrow(run, _RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"at": pa.int64(), "headers": pa.binary(), "payload": pa.binary(), "page_id": pa.int64(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(k, kinds.get(k, pa.string())) for k in rows[0]]))


def write_warc(records: DataFrame, min_bytes: int = MIN_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write converted records to .warc.gz files in the shared folder; returns
    the manifest (path, n) of the files of successful attempts.

    Of responses with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page id (then the first by archive and place) is the response
    that the others refer to.  Records without a page id are never revisits.  Which records
    are is found from digests and places alone, frequent digests dealt over salts; payloads
    stay where they are as long as the list of revisits is short enough to be sent to them.
    """
    spark = records.sparkSession
    folder = work_path(spark, "warc")
    key = ["payload_digest", "payload_bytes"]
    light = stage(records.where(F.col("kind") == "response").where(f"payload_bytes >= {int(min_bytes)} and page_id is not null").select(
        *key, "page_id", "archive", "at", "url", "date"), "digests")
    first = light.groupBy(*key).agg(F.min(F.struct("page_id", "archive", "at", "url", "date")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = salted_join(light.select(*key, "page_id", "archive", "at"), first.drop("n"), key, first.select(*key, "n"), "n", ["archive", "at"])
    revisits = stage(met.where(F.col("first.page_id") != F.col("page_id")).select("archive", "at", "first"), "revisits")
    short = revisits.agg(F.coalesce(F.sum(F.length("archive") + F.length("first.archive") + F.length("first.url") + 100), F.lit(0))).first()[0] <= SENT_BYTES
    joined = records.join(F.broadcast(revisits) if short else revisits, ["archive", "at"], "left").select(
        "archive", "at", "kind", "url", "ip", "date", "mime", "headers", "payload", "page_id", "payload_bytes", "payload_digest", "first")

    def run(batches):
        out, n, size = [], 0, 0

        def flush():
            uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            write_file(uri, b"".join(out))
            out.clear()
            return pa.RecordBatch.from_pylist([{"path": uri, "n": n}])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                of = row.pop("first")
                if of is not None:
                    of["id"] = _record_id(of["archive"], of["at"], of["url"])
                out.append(warc_record(row, of))
                n, size = n + 1, size + len(out[-1])
                if size >= shard_bytes:
                    yield flush()
                    n, size = 0, 0
        if out:
            yield flush()

    return stage(joined.mapInArrow(run, "path string, n long"), "manifest")


def read_pages(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every
    response and revisit of the WARC files.  The digest of a response is computed from
    what was read and must equal its header's."""
    files = manifest.count()  # a row for each file, not for each record

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for own, block in read_warc(read_file(path)):
                    if own["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_block(block)
                    page, size = header_value(head, "X-Page-Id"), header_value(head, "Content-Length")
                    digest = own["warc-payload-digest"].removeprefix("sha1:")
                    if own["warc-type"] == "response" and (digest != base32_sha1(payload) or int(size or len(payload)) != len(payload)):
                        raise ValueError(f"payload of {own['warc-record-id']} differs from its header")
                    refers = own.get("x-refers-to-page")
                    rows.append((int(page) if page else None, int(size or len(payload)), digest, own["warc-type"], int(refers) if refers else None))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("path").repartition(max(1, files)).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages as ARC files, converted to WARC, written and read back.

    Null html is an empty payload; null or blank URLs become ``about:blank`` and
    white space in them ``%20``.  A null page id is kept as null; it is a response
    and nothing refers to it.  Rows given twice under one id are all responses
    if theirs is the smallest id of the payload.  No rows give no rows.
    Other columns are not read.
    """
    return read_pages(write_warc(convert(stand_in_archives(pages)), min_bytes))
