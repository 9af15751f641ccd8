import gzip
import hashlib
import time
import zlib

from pyspark.sql import functions as F

from quillmill.llm import warc

HTML = "<html><head><title>T &amp; x</title><script>var a='<p>';</script></head><body><!-- <p>no</p> --><p>One <b>two</b>&nbsp;&lt;3<br>four</p>\n\n<ul><li>a</li><li>é</li></ul></body></html>"
TEXT = "T & x\nOne two <3\nfour\na\né"
SCHEMA = "record_id string, target_uri string, warc_date string, block string, payload_digest string, record_type int, refers_to string"


def responses(spark):
    head = lambda kind, status=200: f"HTTP/1.1 {status} X\r\nServer: s\r\ncontent-type: {kind}; charset=utf-8\r\n\r\n"
    rows = [
        ("<urn:1>", "http://a/", "2024-01-01T00:00:00Z", head("Text/HTML") + HTML, None),
        ("<urn:2>", "http://b/", "2024-01-02T00:00:00Z", head("image/png", 404) + "xx", "sha1:ABC"),
        ("<urn:3>", "http://c/", None, head("text/plain") + "a\r\n\r\nb <p>", None),
        ("<urn:4>", None, "2024-01-03T00:00:00Z", None, None),
        (None, "http://e/", "2024-01-04T00:00:00Z", "no head", None),
        ("<urn:1>", "http://a/", "2024-01-01T00:00:00Z", head("Text/HTML") + HTML, None),
        ("<urn:6>", "http://f/", "2024-01-05T00:00:00Z", head("text/html"), None),
    ]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_records(spark):
    got = warc.derive(responses(spark)).collect()
    by = {(r.refers_to, r.record_type): r for r in got}
    assert len(got) == 7 + 4 and len([r for r in got if r.refers_to == "<urn:1>"]) == 4
    one = by["<urn:1>", "conversion"]
    assert one.block == TEXT and one.content_length == len(TEXT.encode()) and one.target_uri == "http://a/"
    assert one.block_digest == "sha256:" + hashlib.sha256(TEXT.encode()).hexdigest()
    assert one.payload_digest == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    meta = by["<urn:1>", "metadata"]
    assert meta.block == f"source-status: 200\r\nsource-header: Server: s\r\nsource-header: content-type: Text/HTML; charset=utf-8\r\nsource-payload-digest: {one.payload_digest}\r\n"
    assert meta.record_id != one.record_id and meta.source_status == 200
    assert by["<urn:2>", "metadata"].payload_digest == "sha1:ABC" and ("<urn:2>", "conversion") not in by
    assert by["<urn:3>", "conversion"].block == "a\r\n\r\nb <p>"
    assert by["<urn:4>", "metadata"].source_status is None and ("<urn:4>", "conversion") not in by
    assert by[None, "metadata"].source_headers == "" and by["<urn:6>", "conversion"].block == ""
    assert warc.derive(responses(spark).limit(0)).collect() == []


def test_files_round_trip(spark, tmp_path):
    derived = warc.derive(responses(spark))
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_warc(derived.coalesce(2), path, compression)
        back = warc.read_warc(spark, path)
        columns = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest", F.col("block").cast("string")]
        assert sorted(map(tuple, back.select(*columns).collect()), key=repr) == sorted(map(tuple, derived.select(*columns).collect()), key=repr)


def test_derivatives_of_read_records(spark, tmp_path):
    block = ("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>é</p>").encode()
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:9>\r\nWARC-Target-URI: http://z/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:Q\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "a.warc").write_bytes(record + record)
    got = warc.derive(warc.read_warc(spark, str(tmp_path)).filter("record_type = 'response'")).collect()
    assert len(got) == 4 and {r.payload_digest for r in got} == {"sha1:Q"} and {r.block for r in got if r.record_type == "conversion"} == {"é"}


def test_all_character_references_are_decoded(spark):
    html = "<p>caf&eacute; &auml;&ntilde; &#233;&#8217;&#x2019;&#X1F600; &amp;eacute; &amp;amp; &copy; R&amp 2024 &unknown; &notit; a&b AT&T &#0; x&nbsp;&#160;y &NotEqualTilde;</p>"
    text = "café äñ é’’\U0001f600 &eacute; &amp; © R&amp 2024 &unknown; &notit; a&b AT&T \ufffd x y \u2242\u0338"
    rows = [("<urn:1>", "http://a/", None, f"HTTP/1.1 200 X\r\nContent-Type: {kind}\r\n\r\n{html}", None, 1, "x") for kind in ("text/html", "text/plain", "image/png")]
    got = [r for r in warc.derive(spark.createDataFrame(rows, SCHEMA)).collect() if r.record_type == "conversion"]
    assert [r.block for r in got] == [text, html]
    assert got[0].content_length == len(text.encode()) and got[0].block_digest == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def one(head, body):
    return warc.message(b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n\r\n" + body)[3]


def test_codings_and_charsets():
    page = "<html><meta charset='iso-8859-2'><p>Łódź</p></html>"
    assert one("Content-Type: text/html", page.encode("iso-8859-2")) == "Łódź"
    assert one("Content-Type: text/html; charset=\"windows-1251\"", "<p>где</p>".encode("cp1251")) == "где"
    assert one("Content-Type: text/html; charset=ISO-8859-1", "<p>caf\xe9 \u20ac</p>".encode("cp1252")) == "café €"
    assert one("content-type: text/plain; charset=utf-16", "naïve".encode("utf-16")) == "naïve"
    assert one("Content-Type: text/html; charset=none-such", "<p>é</p>".encode()) == "é" and one("Content-Type: text/html; charset=hex", b"<p>a</p>") == "a"
    assert one("Content-Type: text/plain", b"a\xffb") == "a\ufffdb"
    packed = gzip.compress(page.encode("iso-8859-2"))
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(p), p) for p in (packed[:20], packed[20:])) + b"0\r\n\r\n"
    head = "Content-Type: text/html\r\nContent-Encoding: gzip"
    assert one(head, packed) == "Łódź" and one(head + "\r\nTransfer-Encoding: chunked", chunked) == "Łódź"
    assert one(head, page.encode("iso-8859-2")) == "Łódź"  # decoded before it was stored
    assert one("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(b"<p>d</p>")) == "d"
    assert one("Content-Type: text/html\r\nContent-Encoding: br", b"\x0b\x02\x80") is None and one(head, packed[:12] + b"!!!!!!!!") is None
    assert one("Content-Type: text/plain\r\nTransfer-Encoding: chunked", b"not chunked") == "not chunked"
    assert warc.message(b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n\r\n" + packed)[2] == "sha256:" + hashlib.sha256(packed).hexdigest()


def test_markup_that_regular_pages_lack():
    assert warc.text_of('<p title="a > b" data=\'</p>\'>one</p><a href=x>two</a> 3 < 4 <5 & <3') == "one\ntwo 3 < 4 <5 & <3"
    assert warc.text_of("a<!-- never closed <p>b") == "a" and warc.text_of("a<script>never closed</p>") == "a"
    assert warc.text_of("<SCRIPT>x</p></Script >b<?php x ?>c<!DOCTYPE html>d</ >e") == "bcde"
    assert warc.text_of("<p don't>it's</p>") == "it's" and warc.text_of("<navy>x</navy><nav>y</nav>") == "x\ny"
    assert warc.text_of("<header>a</header><main>b</main><td>c</td>") == "a\nb\nc"


def test_unclosed_markup_takes_linear_time():
    for piece in ("<!-- ", "<script ", "<a \"", "<a '", "<a x='", "<style", "</", "<", "<a =", "&", "<p <p "):
        seconds = []
        for n in (20_000, 200_000):
            began = time.perf_counter()
            warc.text_of(piece * n)
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 40 * seconds[0] + 0.5, (piece, seconds)


def test_many_records_are_read_as_a_stream(spark, tmp_path):
    block = "x" * 5000
    record = lambda i: (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n").encode()
    n = 6000
    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(record(i), 1) for i in range(n)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(map(record, range(n, n + 500)))))
    got = warc.read_warc(spark, str(tmp_path))
    assert [tuple(r) for r in got.agg(F.count("*"), F.count_distinct("record_id"), F.min(F.octet_length("block")), F.max(F.octet_length("block"))).collect()] == [(n + 500, n + 500, 5000, 5000)]
    held = []

    def chunks():
        data = (tmp_path / "many.warc.gz").read_bytes()
        for a in range(0, len(data), 1000):
            held.append(a)
            yield data[a : a + 1000]

    first = next(warc.parse_warc(chunks()))
    assert first["warc-record-id"] == "<urn:0>" and len(held) < 5  # nothing is read ahead
    broken = b"junk WARC/1.0\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: x\r\n\r\nlost\r\n\r\n" + record(1) + b"WARC/1.0\r\ncut"
    assert [r["warc-record-id"] for r in warc.parse_warc(iter([broken]))] == ["<urn:a>", "<urn:1>"]


def test_very_long_text(spark):
    html = "<p>" + "word &amp; " * 300_000 + "</p>"
    rows = [("<urn:1>", "http://a/", None, f"HTTP/1.1 200 X\r\nContent-Type: text/html\r\n\r\n{html}", None, 1, "x")]
    got = [r for r in warc.derive(spark.createDataFrame(rows, SCHEMA)).collect() if r.record_type == "conversion"]
    assert got[0].block == ("word & " * 300_000).strip() and got[0].content_length == len(got[0].block)
