"""WARC archives: legacy ARC archives converted to WARC records, written, and read back.

An ARC record is a header line of blank-separated fields, the last of which is the body's length, and the body.
The first record of an archive tells its version: version 1 has five fields in a line, version 2 ten. A converted
record has the same body as its block; its identifier, date, type and digests are made from line and body, so that
converting again gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import arrow, fresh_path, sliced, through_table
from loomspark.llm.token_files import located

FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: What a field of a line may be; any other has no blanks.
KINDS = {"url": ".*", "date": r"\d+", "type": ".*", "length": r"\d+"}
LINES = {v: re.compile(" ".join(f"(?P<{f}>{KINDS.get(f, r'\S+')})" for f in fields)) for v, fields in FIELDS.items()}
#: Records and bytes of pages of an archive segment at most; a larger page is a segment of its own.
SEGMENT = 2000
SEGMENT_BYTES = 1 << 24
HTTP = "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, place: int, url: str, date: str, digest: str) -> str:
    """An id that a record keeps however often it is converted: by its archive, its place there and what it says."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {place} {url} {date} {digest}')}>"


def plain_url(url: str | None) -> str:
    """A URL that fits a header line: what would end a field or line is escaped."""
    return re.sub(r"[\s\x00-\x1f%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "unknown:"


def arc_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in FIELDS[version]) + "\n").encode()


def arc_segment(version: int, name: str, date: str, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC archive of (url, body) records."""
    about = f"{version} 0 {name}\n{TITLES[version]}\n".encode()
    out, at = io.BytesIO(), 0
    for url, kind, body in [(f"filedesc://{name}", "text/plain", about), *((u, "text/html", b) for u, b in records)]:
        values = {"url": url, "ip": "0.0.0.0", "date": date, "type": kind, "code": "200", "offset": str(at), "filename": name, "length": str(len(body))}
        at += out.write(arc_line(version, values)) + out.write(body) + out.write(b"\n")
    return out.getvalue()


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the one that describes the archive.

    URLs and content types may have blanks: the date between them is all digits. A body is as long as its line says; a line
    that cannot be read, or a body that ends early, is an error.
    """
    version = 0
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not version:
            length = int(text.rpartition(" ")[2])
            body = stream.read(length)
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        names = FIELDS[version]
        values = LINES[version].fullmatch(text)
        if not values:
            raise ValueError(f"ARC line without the {len(names)} fields of its version: {text[:80]!r}")
        fields = values.groupdict()
        body = stream.read(int(fields["length"]))
        if len(body) < int(fields["length"]):
            raise ValueError(f"ARC body of {len(body)} bytes: {text[:80]!r}")
        yield fields, body


#: Ends the header of an HTTP message; many old servers end lines in LF alone.
BLANK_LINE = re.compile(rb"\r?\n\r?\n")


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and payload of an HTTP message; a block of another kind is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    end = BLANK_LINE.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    lines = (x.split(":", 1) for x in head.decode("utf-8", "replace").splitlines()[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in lines}, payload


def iso_date(date: str) -> str:
    """Of an ARC date, YYYYMMDDhhmmss or as many of its digits as there are: the first moment that fits them."""
    d = date[:14] + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


RECORD_SCHEMA = "page_id long, record_id string, target_uri string, date string, ip string, content_type string, block binary, payload_digest string, payload_bytes long"
RECORDS = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("content_type", pa.string()), ("block", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])


def arc_segments(pages: DataFrame, date: str = "20260101000000") -> DataFrame:
    """name, content: ARC archives of pages (page_id, url, html), of version 1 and 2 in turn; a page is an HTTP response."""

    def segments(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0

        def segment(records):
            name = f"pages-{part}-{k}.arc"
            return pa.RecordBatch.from_pydict({"name": [name], "content": [arc_segment(1 + k % 2, name, date, records)]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

        records, size = [], 0
        for batch in batches:
            for small in sliced([batch]):
                for row in small.to_pylist():
                    payload = (row["html"] or "").encode()
                    if records and (len(records) == SEGMENT or size + len(payload) > SEGMENT_BYTES):
                        yield segment(records)
                        records, size, k = [], 0, k + 1
                    own = "" if row["page_id"] is None else f"X-Page-Id: {row['page_id']}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                    records.append((plain_url(row["url"]), head.encode() + payload))
                    size += len(payload)
        if records:
            yield segment(records)

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(segments, "name string, content binary")


def convert_arc(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """The WARC records (see RECORD_SCHEMA) equivalent to the ARC archives in column content, gzipped or not.

    page_id is what the HTTP header X-Page-Id says, else null. Digests are base32 SHA-1; the payload is the HTTP
    message's body, and all of a block of another kind. ip is null where the line names none. An archive without
    records gives no rows. Without ``blocks`` they are left null.
    """

    def convert(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                rows: list[dict] = []
                size = 0
                archive = sha1(content)
                for place, (fields, body) in enumerate(arc_records(stream)):
                    head, payload = http_parts(body)
                    digest, date = sha1(payload), iso_date(fields["date"])
                    kind = HTTP if body.startswith(b"HTTP/") else fields["type"]
                    page = head.get("x-page-id")
                    rows.append({"page_id": int(page) if page else None, "record_id": record_id(archive, place, fields["url"], date, digest), "target_uri": fields["url"], "date": date, "ip": None if fields["ip"] in ("-", "0.0.0.0") else fields["ip"], "content_type": kind, "block": body if blocks else None, "payload_digest": digest, "payload_bytes": len(payload)})
                    size += len(body) if blocks else 256
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)

    return archives.select("content").mapInArrow(convert, RECORD_SCHEMA)


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member with one record."""
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.read(int(fields["content-length"]))


MANIFEST = pa.schema([("name", pa.string()), ("n_records", pa.int64())])
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def mark_revisits(records: DataFrame, payloads: DataFrame, least: int = 0) -> DataFrame:
    """Records with the one that each revisits: columns in_group, refers_page, refers_uri, refers_date, refers_id.

    payloads: record_id, page_id, target_uri, date, payload_digest, payload_bytes of the same records, without their blocks. Of
    records with equal payloads of ``least`` bytes or more, that with the largest page_id is the response; a null
    page_id is the smallest. Of records equal in page_id and payload, that with the largest URI, date and id is the
    response of the others.
    """
    groups = payloads.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(F.struct("page_id", "target_uri", "date", "record_id")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = payloads.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest").join(groups, "payload_digest").select("page_id", "payload_digest", F.col("kept.page_id").alias("refers_page"), F.col("kept.target_uri").alias("refers_uri"), F.col("kept.date").alias("refers_date"), F.col("kept.record_id").alias("refers_id")).distinct()
    a, b = records.alias("a"), links.alias("b")
    both = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.payload_digest") == F.col("b.payload_digest"))
    # a merge join leaves records of one page_id and payload in one partition, which write_warc needs
    return a.join(b.hint("merge"), both, "left").select("a.*", F.col("b.payload_digest").isNotNull().alias("in_group"), "refers_page", "refers_uri", "refers_date", "refers_id")


def write_warc(records: DataFrame, directory: str) -> DataFrame:
    """Write marked records as gzipped WARC files, one a partition; returns the manifest: name, n_records.

    A record is a response if its block is an HTTP message, else a resource, as those of dns: and ftp: are; either may
    be a revisit, which names its payload's length. Records of one page_id and payload must stand in one partition one after the other, as mark_revisits' join and
    sort leave them. Only files that the manifest names count.
    """

    def write(batches):
        files, root = located(directory)
        files.create_dir(root, recursive=True)
        name, n, last = f"{uuid.uuid4().hex}.warc.gz", 0, None
        sink = None
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    sink.write(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", row["date"]), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n"))
                key = row["page_id"], row["payload_digest"]
                revisit = row["in_group"] and (row["page_id"] != row["refers_page"] or key == last)
                last = key
                kind = "response" if row["content_type"] == HTTP else "resource"
                fields = [("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("Content-Type", row["content_type"]), ("WARC-Payload-Digest", "sha1:" + row["payload_digest"])]
                fields += [("WARC-IP-Address", row["ip"])] if row["ip"] else []
                block = row["block"]
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_id"]), ("WARC-Refers-To-Target-URI", row["refers_uri"]), ("WARC-Refers-To-Date", row["refers_date"]), ("X-Payload-Length", str(row["payload_bytes"]))]
                    fields += [] if row["refers_page"] is None else [("X-Refers-To-Page-Id", str(row["refers_page"]))]
                    block = block[: len(block) - row["payload_bytes"]]
                fields.append(("WARC-Block-Digest", "sha1:" + sha1(block)))
                sink.write(warc_record("revisit" if revisit else kind, fields, block))
                n += 1
        if sink is not None:
            sink.close()
            yield arrow({"name": [name], "n_records": [n]}, MANIFEST)

    # of equal pages and payloads that which the others refer to comes first
    ordered = records.sortWithinPartitions("page_id", "payload_digest", F.desc("target_uri"), F.desc("date"), F.desc("record_id"))
    return through_table(ordered.mapInArrow(write, "name string, n_records long"), "warc-manifest")


def read_warc(manifest: DataFrame, directory: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (bare), record_type, refers_to of each response, resource or revisit.

    A revisit's payload is not in its record, which has its length and digest. Those of others are worked out again, and a digest that differs from the record's is an error.
    """

    def read(batches):
        files, root = located(directory)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for fields, block in warc_records(io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 18)):
                        if fields["warc-type"] not in ("response", "resource", "revisit"):
                            continue
                        head, payload = http_parts(block)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(fields["x-payload-length"]) if fields["warc-type"] == "revisit" else len(payload)
                        if fields["warc-type"] != "revisit" and sha1(payload) != digest:
                            raise ValueError(f"{name}: a payload that does not match its digest")
                        page, refers = head.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append({"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": int(refers) if refers else None})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, READ)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, READ)

    names = manifest.select("name").collect()  # one a file
    spark = manifest.sparkSession
    if not names:
        return spark.createDataFrame([], READ_SCHEMA)
    spread = spark.createDataFrame(spark.sparkContext.parallelize(names, len(names)), T.StructType([T.StructField("name", T.StringType())]))
    return spread.mapInArrow(read, READ_SCHEMA)


def archived(archives: DataFrame, directory: str) -> DataFrame:
    """ARC archives as WARC files in a shared folder, read back: a row for each record, see read_warc.

    Revisits are found among the converted records. They are converted twice, as their payloads' digests alone are
    shuffled the first time.
    """
    payloads = convert_arc(archives, blocks=False).select("record_id", "page_id", "target_uri", "date", "payload_digest", "payload_bytes")
    return read_warc(write_warc(mark_revisits(convert_arc(archives), payloads), directory), directory)


def archived_pages(pages: DataFrame, date: str = "20260101000000") -> DataFrame:
    """Pages as ARC archives, converted to WARC files in the shared folder, and read back: a row for each page.

    Null html is an empty payload. Pages of equal payloads are one response, that of the largest page_id, and
    revisits of it. Null page_ids come back null; other columns are ignored.
    """
    return archived(arc_segments(pages, date), fresh_path(pages.sparkSession, "warc"))
