"""Legacy archive converter: ARC files to WARC records.

An ARC file opens with a version block (``filedesc://``) that declares the
version and, on its last line, the fields of every later record line. Version
1 lines have five fields, version 2 lines ten; the last field is always the
declared length of the record that follows. ``read_arc`` walks a file by those
lengths and never searches payloads for separators.

Each record becomes a WARC record: ``filedesc:`` blocks become ``warcinfo``,
HTTP responses ``response``, everything else (``dns:`` answers, bodies without
HTTP head) ``resource``. The identifier is a name-based UUID of URL, time and
block digest, so a rerun writes the same one; 14-digit times (or shorter ones,
filled up) become ISO 8601; block and payload digests are base32 SHA-1.

``mark_revisits`` turns records with equal payloads into revisits of the one
with the smallest page_id. ``write_warc`` writes archives of bounded records and
bytes with Spark's text writer (a row is an archive), and ``read_warc`` parses
them again by Content-Length.

A damaged archive fails no task: plain and gzip files (member by member) are
read as far as they can be, and what cannot is a row with path, offset and
reason. A file is one value of a row, so it is bounded by 2 GB.

Defined cases: a null html is an empty payload; a null or odd url is
percent-coded or ``urn:unknown``; rows that repeat the smallest page_id of a
payload are all responses; a null page_id is always a response; other columns
are ignored; empty tables and null or empty files give empty results; URLs
may hold spaces.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, saved, table

V1 = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
V2 = ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
      "Filename", "Archive-length"]
#: A record line's last field and its time (14 digits, or a prefix of them).
LENGTH, DATE = re.compile("[0-9]{1,15}"), re.compile("[0-9]{4,17}")
GZIP = b"\x1f\x8b\x08"
CRLF = b"\r\n"
SEPARATOR = "\r\n\r\n"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_url(url: str | None) -> str:
    if not url:
        return "urn:unknown"
    return "".join(c if "\x21" <= c <= "\x7e" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
                   for c in url)


# --- ARC -------------------------------------------------------------------

def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of (url, ip, 14-digit time, content type, block) records."""
    fields = V1 if version == 1 else V2
    body = f"{version} 0 quarry\n{' '.join(fields)}\n".encode()
    out, at = [], 0

    def add(url, ip, date, kind, block):
        nonlocal at
        line = [url, ip, date, kind]
        if version == 2:
            line += ["200", sha1_32(block), "-", str(at), name]
        raw = (" ".join([*line, str(len(block))])).encode() + b"\n" + block + b"\n"
        out.append(raw)
        at += len(raw)

    add(f"filedesc://{name}", "0.0.0.0", records[0][2] if records else "19960101000000", "text/plain", body)
    for r in records:
        add(*r)
    return b"".join(out)


def unzipped(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of all gzip members of ``data`` (or ``data`` itself) and what
    is wrong with them: a damaged member ends at its damage, and the next one
    is searched by its magic bytes."""
    if not data.startswith(GZIP):
        return data, None
    out, reason = [], None
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
            if not member.eof:
                return b"".join(out), "a gzip member is cut off"
            data = member.unused_data.lstrip(b"\0")
            damaged = bool(data) and not data.startswith(GZIP)
        except zlib.error:
            damaged = True
        if damaged:
            reason = "a gzip member is damaged"
            at = data.find(GZIP, 1)
            data = data[at:] if at > 0 else b""
    return b"".join(out), reason


def read_arc(data: bytes) -> Iterator[tuple[int, dict | None, bytes, str | None]]:
    """(offset, fields, block, reason) of every record, the version block
    first. What cannot be read has no fields but a reason: after an odd record
    line the next line that is one goes on; a record that is longer than the
    rest of the file ends it, as its own bytes may look like records."""
    at, fields, lost = 0, V1, False
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            if not lost:
                yield at, None, b"", "a record line without an end"
            return
        line = data[at:end].decode("utf-8", "replace").strip("\r")
        first = line.startswith("filedesc:")
        names = (V1 if line.count(" ") == len(V1) - 1 else V2) if first else fields
        parts = line.rsplit(" ", len(names) - 1)  # a URL may hold spaces
        head = dict(zip(names, parts, strict=False))
        if len(parts) != len(names) or not LENGTH.fullmatch(parts[-1]) or not DATE.fullmatch(head.get("Archive-date", "")):
            if not lost:
                yield at, None, b"", f"no record line of the {len(names)} declared fields"
            at, lost = end + 1, True
            continue
        size, lost = int(parts[-1]), False
        block = data[end + 1:end + 1 + size]
        if len(block) != size:
            yield at, None, b"", f"a record is cut off: {len(block)} of {size} bytes"
            return
        if first:
            lines = block.decode("utf-8", "replace").splitlines()
            told = lines[1].split(" ") if len(lines) > 1 else names
            fields = told if set(V1) <= set(told) and told[-1] == V1[-1] else names
        yield at, head, block, None
        at = end + 1 + size


# --- ARC record to WARC record ---------------------------------------------

def iso_time(digits: str) -> str:
    """14 digits, or a prefix of them, as ISO 8601 in UTC."""
    d = re.sub(r"\D", "", digits)[:14]
    d += "19960101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_split(block: bytes) -> tuple[bytes, bytes] | None:
    if not block.startswith(b"HTTP/"):
        return None
    head, sep, payload = block.partition(CRLF + CRLF)
    return (head + sep, payload) if sep else None


def convert(head: dict, block: bytes) -> dict:
    url, date = head["URL"], iso_time(head["Archive-date"])
    split = http_split(block)
    if url.startswith("filedesc:"):
        kind, mime, split = "warcinfo", "application/warc-fields", None
    elif split:
        kind, mime = "response", "application/http; msgtype=response"
    else:
        kind, mime = "resource", head["Content-type"]
    http, payload = split or (b"", block)
    block_digest = sha1_32(block)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {block_digest}")
    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
    return {"record_id": f"<urn:uuid:{name}>", "kind": kind, "uri": url, "date": date, "ip": head["IP-address"],
            "mime": mime, "page_id": int(page[1]) if page else None, "http": http, "payload": payload,
            "payload_bytes": len(payload), "payload_digest": sha1_32(payload)}


RECORD = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()),
    ("ip", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()), ("http", pa.binary()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("path", pa.string()), ("offset", pa.int64()), ("reason", pa.string())])
RECORD_DDL = ("record_id string, kind string, uri string, date string, ip string, mime string, page_id bigint, "
              "http binary, payload binary, payload_bytes bigint, payload_digest string, path string, offset bigint, reason string")


def batches(rows: Iterator[dict], schema: pa.Schema, size=lambda r: 0, most_rows=4096, most_bytes=16 << 20):
    """Arrow batches of bounded rows and bytes."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if len(held) >= most_rows or n >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def convert_archives(archives: DataFrame) -> DataFrame:
    """WARC records (columns of ``RECORD``) of ARC files in ``content``, gzip
    or plain. What cannot be read is a row of kind ``broken`` with ``path`` (if
    ``archives`` has it), byte ``offset`` (unpacked) and ``reason``."""
    def run(it):
        def rows():
            for b in it:
                for c, path in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    data, damage = unzipped(c.as_py() or b"")
                    for at, head, block, reason in read_arc(data):
                        made = convert(head, block) if head is not None else BROKEN
                        yield {**made, "path": path, "offset": at, "reason": reason}
                    if damage:
                        yield {**BROKEN, "path": path, "offset": len(data), "reason": damage}
        yield from batches(rows(), RECORD, lambda r: r["payload_bytes"])
    path = F.col("path").cast("string") if "path" in archives.columns else F.lit(None).cast("string")
    return archives.select("content", path.alias("path")).mapInArrow(run, RECORD_DDL)


BROKEN = {n: None for n in RECORD.names} | {"kind": "broken", "payload_bytes": 0}


def pages_to_arc(pages: DataFrame, per_file: int = 256, most_bytes: int = 8 << 20) -> DataFrame:
    """``pages`` as legacy archives (``content`` binary): up to ``per_file``
    records or ``most_bytes`` each (one larger page has a file of its own),
    versions 1 and 2 in turn."""
    def block(page_id, html):
        mark = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
        payload = (html or "").encode("utf-8", "surrogatepass")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
        return head.encode() + payload

    def run(it):
        n, held, size = 0, [], 0

        def flush():
            nonlocal n, held, size
            data = arc_file(held, 1 + n % 2, f"pages-{n}.arc")
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_pydict({"content": pa.array([data], pa.binary())})

        for b in it:
            for page_id, url, html in zip(*(b.column(i) for i in range(3)), strict=True):
                k = page_id.as_py()
                held.append((arc_url(url.as_py()), "192.0.2.1", f"2008{1 + (k or 0) % 12:02d}01120000", "text/html",
                             block(k, html.as_py())))
                size += len(held[-1][-1])
                if len(held) >= per_file or size >= most_bytes:
                    yield flush()
        if held:
            yield flush()
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "content binary")


# --- revisits, WARC files ---------------------------------------------------

def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to`` and ``refers_to_id``: page_id and record id of the
    response that a record with an equal payload of at least ``min_bytes``
    revisits, null for the others. Only ids and digests are shuffled by
    digest (with map-side minima); payloads are dealt by record id, evenly."""
    key = ["payload_digest", "payload_bytes"]
    narrow = records.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)
                           & (F.col("kind") == "response")).select("record_id", "page_id", *key)
    first = narrow.groupBy(*key).agg(F.min(F.struct("page_id", "record_id")).alias("first"))
    later = (narrow.join(first, key).where(F.col("page_id") > F.col("first.page_id"))
             .groupBy("record_id", "page_id").agg(F.min("first").alias("first")))
    return (records.join(later, ["record_id", "page_id"], "left")
            .withColumn("refers_to", F.col("first.page_id")).withColumn("refers_to_id", F.col("first.record_id"))
            .drop("first"))


def warc_record(r: dict) -> bytes:
    """A record without the separator that ends it."""
    revisit = r["refers_to"] is not None
    block = r["http"] if revisit else r["http"] + r["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['kind']}", f"WARC-Record-ID: {r['record_id']}",
            f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}",
            f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{sha1_32(block)}",
            f"X-Payload-Length: {r['payload_bytes']}"]
    if r["page_id"] is not None:
        head.append(f"X-Page-Id: {r['page_id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {r['refers_to_id']}", f"X-Refers-To-Page: {r['refers_to']}"]
    head += [f"Content-Type: {r['mime']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block


def write_warc(records: DataFrame, path: str, records_per_file: int = 4096, bytes_per_file: int = 16 << 20) -> None:
    """WARC archives (gzip) under ``path``, of at most ``records_per_file``
    records and ``bytes_per_file`` bytes unpacked (one longer record has a file
    of its own); broken records are left out."""
    def run(it):
        held, size = [], 0

        def flush():
            nonlocal held, size
            whole = SEPARATOR.encode().join(held)
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"value": pa.array([whole], pa.binary())})
        for b in it:
            for i in range(b.num_rows):
                raw = warc_record({n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)})
                if held and (len(held) >= records_per_file or size + len(raw) > bytes_per_file):
                    yield flush()
                held.append(raw)
                size += len(raw) + len(SEPARATOR)
        if held:
            yield flush()
    whole = records.where("kind != 'broken'").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # a row is an archive
    (whole.write.option("lineSep", SEPARATOR).option("compression", "gzip")
     .option("maxRecordsPerFile", 1).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[int, dict | None, bytes, str | None]]:
    """(offset, head, block, reason) of every record by its Content-Length; after
    what cannot be read the next ``WARC/`` that follows a separator goes on, but
    for a record longer than the rest of the file, which ends it."""
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        lines = data[at:max(end, at)].decode("utf-8", "replace").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = head.get("Content-Length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not LENGTH.fullmatch(size):
            yield at, None, b"", "no WARC record head"
            at = data.find(b"\r\n\r\nWARC/", at) + 4
            if at < 4:
                return
            continue
        start = end + 4
        block = data[start:start + int(size)]
        if len(block) != int(size):
            yield at, None, b"", f"a record is cut off: {len(block)} of {size} bytes"
            return
        yield at, head, block, None
        at = start + int(size) + len(SEPARATOR)


PAGE_DDL = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
            "record_id string, target_uri string, date string, payload_intact boolean, path string, offset bigint, reason string")
PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
                  ("target_uri", pa.string()), ("date", pa.string()), ("payload_intact", pa.bool_()),
                  ("path", pa.string()), ("offset", pa.int64()), ("reason", pa.string())])


def page_of(head: dict, block: bytes) -> dict:
    """What a WARC record tells; a response's payload length and digest are
    taken anew from its payload."""
    n = lambda k: int(head[k]) if SIGNED.fullmatch(head.get(k, "")) else None
    said = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    size, digest = n("X-Payload-Length"), said
    if head.get("WARC-Type") != "revisit":
        payload = (http_split(block) or (b"", block))[1]
        size, digest = len(payload), sha1_32(payload)
    return {"page_id": n("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": head.get("WARC-Type"),
            "refers_to": n("X-Refers-To-Page"), "record_id": head.get("WARC-Record-ID"),
            "target_uri": head.get("WARC-Target-URI"), "date": head.get("WARC-Date"),
            "payload_intact": None if said is None else digest == said}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path`` (columns of ``PAGE``), each
    archive unpacked in one task. What cannot be read is a row of type
    ``broken`` with ``path``, byte ``offset`` (unpacked) and ``reason``."""
    def run(it):
        def rows():
            for b in it:
                for c, name in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    data, damage = unzipped(c.as_py())
                    for at, head, block, reason in parse_warc(data):
                        made = page_of(head, block) if head is not None else LOST
                        yield {**made, "path": name, "offset": at, "reason": reason}
                    if damage:
                        yield {**LOST, "path": name, "offset": len(data), "reason": damage}
        yield from batches(rows(), PAGE)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content", "path").mapInArrow(run, PAGE_DDL)


SIGNED = re.compile("-?[0-9]{1,18}")
LOST = {n: None for n in PAGE.names} | {"record_type": "broken"}


def op9_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = saved(convert_archives(pages_to_arc(table(spark, sf_dir, "pages"))), "warc-records")
    path = new_folder(spark, "warc")
    write_warc(mark_revisits(records.where("kind NOT IN ('warcinfo', 'broken')")), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                         "record_id", "target_uri", "date", "payload_intact")


#: DuckDB has no SHA-1 in base32; the query is tested against hashlib instead.
SQL = None
