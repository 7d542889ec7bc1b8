import gzip
import hashlib
import re
import zlib
from html import unescape

import pytest

from panelweave.llm import warc

HTML = b"<html lang='de'><head><title>A &amp; B</title><style>x{}</style></head><body><p>One<br>two&nbsp;&copy; <a href='/x'>three</a><script>no()</script><!-- no --><p>four</body></html>"


def http(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(h + b"\r\n" for h in headers) + b"\r\n" + body


def record(block, **more):
    return {"record_id": "<urn:uuid:1>", "target_uri": "http://a/", "date": "2024-01-01T00:00:00Z", "payload_digest": None, "block": block} | more


def test_html():
    meta, text = warc.derivatives(record(http(HTML, b"Content-Type: text/html; charset=utf-8", b"X-A: b")))
    assert text["block"].decode() == "One\ntwo © three\nfour"
    assert (meta["warc_type"], text["warc_type"]) == ("metadata", "conversion")
    assert b"title: A & B" in meta["block"] and b"outlink: /x" in meta["block"] and b"lang: de" in meta["block"]
    for r in (meta, text):
        assert r["refers_to"] == "<urn:uuid:1>" and r["payload_digest"] == warc.digest(HTML) and r["source_status"] == 200 and "X-A" in r["source_headers"]
        assert r["block_digest"] == warc.digest(r["block"])


def test_encodings():
    chunked = b"4\r\n<p>o\r\n2\r\nne\r\n0\r\n\r\n"
    assert warc.derivatives(record(http(chunked, b"Content-Type: text/html", b"Transfer-Encoding: chunked")))[1]["block"] == b"one"
    assert warc.derivatives(record(http(gzip.compress(b"<p>one"), b"Content-Type: text/html", b"Content-Encoding: gzip")))[1]["block"] == b"one"
    broken = warc.derivatives(record(http(b"not gzip", b"Content-Type: text/plain", b"Content-Encoding: gzip")))
    assert broken[1]["block"] == b"not gzip"
    latin = warc.derivatives(record(http("<p>é".encode("latin-1"), b"Content-Type: text/html; charset=iso-8859-1")))
    assert latin[1]["block"].decode() == "é"
    assert warc.derivatives(record(http(b"x", b"Content-Type: text/html; charset=nonsense")))[1]["block"] == b"x"


def test_bad_input_is_no_error():
    page = b"Content-Type: text/html"
    text = lambda block: warc.derivatives(record(block))[1]["block"].decode()
    assert text(http(b"<p>one<![foo[x]]><p>two", page)) == "one\ntwo"
    assert text(http(b"<p>hello</p><script>var x=1</script><![foo[x]]> tail<script>y</script>", page)) == "hello\ntail"
    assert text(http(b"<p>a<![CDATA[b]]>c<![if IE]>d<![endif]>e<![ [f]]>g<![", page)).replace("b]]>", "") in ("acdeg", "acdeg<![")
    assert text(http(b"<p>x</p>" + b"<![foo[y]]>z" * 20_000, page)) == "x\n" + "z" * 20_000
    for name in ("idna", "undefined", "utf-7", "unicode_escape", "raw_unicode_escape", "punycode", "rot13", "utf-8-sig", "base64", "\x00"):
        assert text(http(b"<p>one +2AA- \\ud800", page + b"; charset=" + name.encode())).startswith("one")
    assert text(http("<p>é".encode("utf-16"), page + b"; charset=utf-16")) == "é"
    for size in (b"-5", b"-1", b"zz", b"", b"ffffffffffff"):
        assert isinstance(text(http(size + b"\r\n<p>one\r\n0\r\n\r\n", page, b"Transfer-Encoding: chunked")), str)
    assert text(http(gzip.compress(b"<p>one")[:-9], page, b"Content-Encoding: gzip"))
    assert text(http(gzip.compress(b"<p>one") + gzip.compress(b" two"), page, b"Content-Encoding: gzip")) == "one two"
    for raw in (15, -15):
        z = zlib.compressobj(wbits=raw)
        assert text(http(z.compress(b"<p>one") + z.flush(), page, b"Content-Encoding: deflate")) == "one"


def test_a_body_that_grows_too_large_is_kept(monkeypatch):
    monkeypatch.setattr(warc, "MOST_DECODED", 1000)
    small, large = gzip.compress(b"a" * 1000), gzip.compress(b"a" * 1001)
    headers = [("Content-Encoding", "gzip")]
    assert warc.payload(headers, small) == b"a" * 1000 and warc.payload(headers, large) == large
    assert warc.payload(headers, gzip.compress(b"a" * 600) * 2) == gzip.compress(b"a" * 600) * 2


def test_a_value_cannot_add_a_header():
    made = warc.derivatives(record(http(HTML, b"Content-Type: text/html", b"X: a"), target_uri="http://a/\r\nWARC-Type: evil\r\n\r\nx"))
    for r in made:
        back = list(warc.records_in(warc.as_bytes(r)))
        assert len(back) == 1 and back[0]["warc_type"] == r["warc_type"] and back[0]["block"] == r["block"]
        assert back[0]["target_uri"] == "http://a/ WARC-Type: evil x" and back[0]["payload_digest"] == r["payload_digest"]


def plain_words(html):
    """The visible words of a page, by patterns alone."""
    t = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|title)\b.*?</\1\s*>", " ", html)
    return unescape(re.sub(r"(?s)<[^>]*>", " ", t)).split()


def test_text_like_a_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = {r.page_id: r.block.decode() for r in warc.derived(warc.responses_of(pages), "page_id").where("warc_type = 'conversion'").collect()}
    for r in pages.collect():
        assert "".join(made[r.page_id].split()) == "".join(plain_words(r.html or "")), r.page_id


def test_other_kinds():
    assert [r["warc_type"] for r in warc.derivatives(record(http(b"\x89PNG", b"Content-Type: image/png")))] == ["metadata"]
    assert warc.derivatives(record(b"<p>bare"))[1]["source_status"] is None
    assert warc.derivatives(record(None))[1]["block"] == b""


def test_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = warc.derived(warc.responses_of(pages), "page_id").drop("page_id").cache()
    assert made.count() == 2 * pages.count()
    files = spark.createDataFrame([(b"".join(r.bytes for r in warc.serialized(made).collect()),)], "content binary")
    back = warc.parsed(files)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, made.collect())))


def test_records_link(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    responses = warc.responses_of(pages)
    made = warc.report(pages)
    assert made.join(responses, made.refers_to == responses.record_id, "left_anti").count() == 0
    assert made.select("record_id").distinct().count() == made.count()
    body = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for r in made.where("warc_type = 'conversion'").collect():
        assert r.payload_digest == warc.digest(body[r.page_id])


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a", ""), (None, "http://b", "<p>x"), (3, "u", "<" * 5000 + "x"), (3, "u", "<" * 5000 + "x"), (4, "u", "<p>" + "a b " * 100_000), (5, "u\r\nx: y", "a<![if x]>b<![foo[x]]>c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS block", "2 AS record_id")
    made = warc.report(pages).collect()
    assert len(made) == 14 and {r.content_length for r in made if r.page_id == 1 and r.warc_type == "conversion"} == {0}
    assert warc.report(pages.limit(0)).count() == 0
    assert all(r.block_sha256 == hashlib.sha256(b"").hexdigest() for r in made if r.page_id == 2 and r.warc_type == "conversion")


@pytest.mark.parametrize("before", ["", "<p>one</p>\n<script>s</script>\n", "a\nb<b>c\n\n"])
def test_a_parser_that_gives_up_leaves_the_rest_once(monkeypatch, before):
    def refuse(self, i, report=1):
        raise AssertionError("refused")

    monkeypatch.setattr(warc.Page, "parse_marked_section", refuse)
    want = warc.read_page(before).text() + "\n" + "<![x]> rest <i>of</i> it"
    assert warc.read_page(before + "\n<![x]> rest <i>of</i> it").text() == want.strip()
