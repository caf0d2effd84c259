import base64
import gzip
import hashlib
import io

import pytest

from loomspark.llm import warc
from loomspark.llm.common import read
from tests.llm.conftest import rows_of


def expected(rows):
    most, seen, out = {}, set(), []
    for i, html in rows:
        key = html or ""
        most[key] = max(most.get(key, (-1, None)), (-1 if i is None else i, i), key=lambda x: x[0])
    for i, html in rows:
        data = (html or "").encode()
        kept = most[html or ""][1]
        again = i != kept or (i, html or "") in seen
        seen.add((i, html or ""))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=repr)


def test_pages(spark):
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    assert rows_of(warc.archived_pages(pages)) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_awkward(spark, no_rows):
    rows = [(1, "a b\n%", "x"), (2, None, "x"), (3, "http://é.example/", None), (4, "u", ""), (5, "u", "\r\n\r\n\x00long" * 9999), (5, "u", "\r\n\r\n\x00long" * 9999), (None, "u", "x"), (None, "u", "x"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    assert rows_of(warc.archived_pages(pages)) == expected([(r[0], r[2]) for r in rows])
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_pages(none).collect() == []


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_arc_versions(spark, version, zipped):
    bodies = [b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\n\r\npay\nload", b"", b"no message\n\n"]
    data = warc.arc_segment(version, "a.arc", "19961104142103", [("http://a/b c", b) for b in bodies])
    if zipped:
        data = gzip.compress(data)
    got = warc.convert_arc(spark.createDataFrame([(bytearray(data),)], "content binary")).collect()
    assert [bytes(r.block) for r in got] == bodies
    assert [r.page_id for r in got] == [5, None, None]
    assert [r.payload_bytes for r in got] == [8, 0, 12]
    assert {(r.target_uri, r.date) for r in got} == {("http://a/b c", "1996-11-04T14:21:03Z")}
    assert got[0].content_type.startswith("application/http") and got[2].content_type == "text/html"


def test_bad_archives():
    data = warc.arc_segment(1, "a.arc", "19961104142103", [("http://a/", b"0123456789")])
    with pytest.raises(ValueError, match="body"):
        list(warc.arc_records(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError, match="version"):
        list(warc.arc_records(io.BytesIO(data.replace(b"\n1 0", b"\n7 0"))))


def test_line_ends_and_blanks_of_old_records():
    for end in (b"\n", b"\r\n"):
        head, payload = warc.http_parts(end.join([b"HTTP/1.0 200 OK", b"Content-Type: text/html", b"", b"<html>\n\nx"]))
        assert (head, payload) == ({"content-type": "text/html"}, b"<html>\n\nx")
    assert warc.http_parts(b"HTTP/1.0 204 No Content\nServer: x") == ({"server": "x"}, b"")
    about = b"1 0 name\nURL IP-address Archive-date Content-type Archive-length\n"
    lines = b"filedesc://a 0.0.0.0 20260101000000 text/plain %d\n" % len(about) + about + b"\n"
    lines += b"http://a/b c 1.2.3.4 19990102030405 text/html; charset=x 4\nbody\n"
    ((fields, body),) = warc.arc_records(io.BytesIO(lines))
    assert (fields["url"], fields["ip"], fields["date"], fields["type"], body) == ("http://a/b c", "1.2.3.4", "19990102030405", "text/html; charset=x", b"body")


def test_records_of_other_kinds(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 10)
    bodies = [b"HTTP/1.0 200 OK\n\nsame", b"same", b"HTTP/1.0 200 OK\nContent-Length: 99\n\nsame", b"a.example. 1 IN A 1.2.3.4", b"HTTP/1.0 204 No Content\r\n\r\n"]
    urls = ["http://a/", "ftp://a/", "http://b/", "dns:a", "http://c/"]
    data = warc.arc_segment(1, "a.arc", "19961104142103", list(zip(urls, bodies))).replace(b"dns:a 0.0.0.0", b"dns:a 9.8.7.6")
    archives = spark.createDataFrame([(bytearray(data),)], "content binary")
    records = warc.convert_arc(archives).collect()
    assert [r.ip for r in records] == [None, None, None, "9.8.7.6", None]
    got = warc.archived(archives, warc.fresh_path(spark, "warc-test")).collect()
    kinds = [r.record_type for r in sorted(got, key=lambda r: r.payload_bytes)]
    assert kinds[0] == "response" and kinds[4] == "resource" and sorted(kinds[1:4])[1:] == ["revisit"] * 2 and sorted(kinds[1:4])[0] != "revisit"
    assert [r.payload_bytes for r in sorted(got, key=lambda r: r.payload_bytes)] == [0, 4, 4, 4, 25]
    pages = spark.createDataFrame([(k, "u", "x" * k) for k in range(12)], "page_id long, url string, html string").coalesce(1)
    assert warc.arc_segments(pages).count() > 5
    assert {r.page_id: r.payload_bytes for r in warc.archived_pages(pages).collect()} == {k: k for k in range(12)}


def test_ids_are_unique_and_revisits_refer_to_their_response(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (2, "v", "same"), (None, "u", "same"), (3, "u", ""), (4, "u", ""), (5, "u", "alone"), (None, "w", "none"), (None, "w", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    directory = warc.fresh_path(spark, "warc-test")
    archives = warc.arc_segments(pages).persist()
    payloads = warc.convert_arc(archives, blocks=False)
    manifest = warc.write_warc(warc.mark_revisits(warc.convert_arc(archives), payloads), directory).collect()
    files, root = warc.located(directory)
    found = []
    for m in manifest:
        with files.open_input_stream(f"{root}/{m['name']}", compression=None) as source:
            found += [f for f, _ in warc.warc_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(source.read()))))]
    ids = [f["warc-record-id"] for f in found]
    assert len(ids) == len(set(ids)) == len(rows) + len(manifest)
    whole = {f["warc-record-id"]: f for f in found if f["warc-type"] == "response"}
    again = [f for f in found if f["warc-type"] == "revisit"]
    assert len(whole) == 4 and len(again) == 6
    for f in again:
        assert f["warc-payload-digest"] == whole[f["warc-refers-to"]]["warc-payload-digest"]
        assert f["warc-refers-to-target-uri"] == whole[f["warc-refers-to"]]["warc-target-uri"]


def test_short_dates():
    assert [warc.iso_date(d) for d in ("2026", "199611", "19961104", "1996110414", "19961104142103")] == ["2026-01-01T00:00:00Z", "1996-11-01T00:00:00Z", "1996-11-04T00:00:00Z", "1996-11-04T14:00:00Z", "1996-11-04T14:21:03Z"]
