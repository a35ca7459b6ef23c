import base64
import hashlib
import re
from html.parser import HTMLParser

from leadtime.llm import warc as W

PAGE = ('<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>'
        "<body><!-- no --><p>One<b> two</b><br>three&nbsp;&eacute;<p><a href='/x?a=1&amp;b=2'>l</a> <a class=k href=y>m</a> <a href=\"/x?a=1&amp;b=2\">n</a>")


def parse(record):
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return headers, rest[:n]


def test_plain_text():
    assert W.plain_text(PAGE) == "A & B\nOne two\nthree é\nl m n"
    assert W.plain_text("a < b <c") == "a < b" and W.plain_text("x<script>never closed") == "x" and W.plain_text("<!-- open") == ""
    assert len(W.plain_text("<" * 200_000)) == 200_000 and W.plain_text("<p " * 100_000) == ""


def test_records_link_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", PAGE), (None, None, None), (1, "http://a/\r\nX: y", PAGE)], "page_id long, url string, html string")
    rows = W.derivatives(W.responses(pages)).collect()
    assert len(rows) == 3 and rows[0].metadata == rows[2].metadata
    for r in rows:
        for x, kind in ((r.metadata, "metadata"), (r.conversion, "conversion")):
            headers, block = parse(bytes(x.record))
            assert headers["WARC-Type"] == kind and headers["WARC-Refers-To"] == r.response.record_id == x.refers_to
            assert headers["WARC-Block-Digest"] == W.digest(block) == x.block_digest and headers["WARC-Record-ID"] == x.record_id
            assert headers["WARC-Source-Payload-Digest"] == W.digest((r.html or "").encode()) == r.response.payload_digest
            assert "X" not in headers
        assert ("WARC-Target-URI" in headers) == (r.url is not None)
        assert block.decode() == W.plain_text(r.html or "") == r.plain
    meta = parse(bytes(rows[0].metadata.record))[1].decode()
    assert "source-Content-Type: text/html; charset=utf-8\r\n" in meta and "outlink: /x?a=1&b=2\r\n" in meta and "title: A & B\r\n" in meta
    assert rows[0].links == ["/x?a=1&b=2", "y"] and rows[0].language == "fr" and rows[1].title is None


def test_query_equals_direct_computation(spark, sf):
    from leadtime.llm.catalog import QUERIES
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op9_warc_derivatives"](spark, sf).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        p = pages[r.page_id]
        assert r.source_digest == W.digest(p.html.encode()) and r.refers_to == W.record_id("response", p.page_id, p.url, r.source_digest)
        assert r.n_chars == len(W.plain_text(p.html)) and r.n_links == len(set(re.findall(r'<a\s[^<>]*?href\s*=\s*"([^"<>]*)"', p.html)))
        if r.type == "conversion":
            assert r.block_digest == W.digest(W.plain_text(p.html).encode())
        assert re.fullmatch("[0-9a-f]{64}", r.record_sha256)
    assert hashlib.sha256


def test_null_response_and_empty_table(spark):
    one = W.responses(spark.createDataFrame([(1, "u", "h", "clash")], "page_id long, url string, html string, metadata string"))
    from pyspark.sql import functions as F
    r = W.derivatives(one.withColumn("response", F.when(F.lit(False), F.col("response")))).first()
    assert r.metadata is None and r.conversion is None and r.plain is None
    assert W.derivative_table(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Reader(HTMLParser):
    """Text, title, language and links of simple pages by the standard library's parser."""

    LINE = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}

    def __init__(self, page):
        super().__init__()
        self.out, self.title, self.lang, self.links, self.hidden, self.in_title = [], None, None, [], 0, False
        self.feed(page)
        self.close()
        lines = [" ".join(x.split()) for x in "".join(self.out).split("\n")]
        self.text = "\n".join(x for x in lines if x)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "a" and a.get("href") is not None and a["href"] not in self.links:
            self.links.append(a["href"])
        if tag == "title":
            self.in_title, self.title = True, self.title or ""
        if tag in self.LINE:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden -= 1
        if tag == "title":
            self.in_title = False
        if tag in self.LINE:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)                # a line end of the page ends a line
            if self.in_title:
                self.title += data


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_equals_an_independent_reader(spark, sf):
    from leadtime.llm.catalog import QUERIES
    src = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    records = {(r.page_id, k): bytes(r[k].record) for r in W.derivatives(W.responses(src)).select("page_id", "metadata", "conversion").collect()
               for k in ("metadata", "conversion")}
    pages = {r.page_id: r for r in src.collect()}
    rows = QUERIES["op9_warc_derivatives"](spark, sf).collect()
    assert {(r.page_id, r.type) for r in rows} == set(records)
    for r in rows:
        page = pages[r.page_id]
        read = Reader(page.html)
        headers, block = parse(records[r.page_id, r.type])
        assert r.record_sha256 == hashlib.sha256(records[r.page_id, r.type]).hexdigest() and r.record_bytes == len(records[r.page_id, r.type])
        assert headers["WARC-Target-URI"] == page.url and headers["WARC-Refers-To"] == r.refers_to
        assert headers["WARC-Block-Digest"] == r.block_digest == sha1(block)
        assert headers["WARC-Source-Payload-Digest"] == r.source_digest == sha1(page.html.encode())
        assert (r.title, r.language, r.n_links) == (" ".join(read.title.split()) if read.title else None, read.lang, len(read.links))
        if r.type == "conversion":
            assert block.decode() == read.text
        else:
            fields = [line.split(": ", 1) for line in block.decode().split("\r\n") if line]
            assert [v for k, v in fields if k == "outlink"] == read.links
            assert dict(fields)["payload-bytes"] == str(len(page.html.encode())) and dict(fields)["text-characters"] == str(len(read.text))


def test_a_link_cannot_start_another_field(spark):
    page = '<a href="http://x/\r\ntitle: forged">a</a><a href="&#13;&#10;language: xx">b</a><title>real\r\noutlink: no</title>'
    r = W.derivatives(W.responses(spark.createDataFrame([(1, "http://u/", page)], "page_id long, url string, html string"))).first()
    lines = parse(bytes(r.metadata.record))[1].decode().split("\r\n")
    assert [x for x in lines if x.startswith("title")] == ["title: real outlink: no"]
    assert [x for x in lines if x.startswith("outlink")] == ["outlink: http://x/title: forged", "outlink: language: xx"]
    assert not [x for x in lines if x.startswith("language")]
