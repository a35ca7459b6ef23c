"""WARC derivatives: each response record gives a metadata and a plain-text conversion record.

Both carry their own id, the response's id in ``WARC-Refers-To``, its target and date, digests of their
blocks, and the response's payload digest; the metadata record repeats the source's HTTP headers and
adds title, language, links and sizes.  Ids are name-based (version 5) UUIDs of what they name, so a run
that is repeated after a lost executor gives the same records.

Text extraction: scripts, styles, templates and comments go (an unclosed one to the end); block tags
end a line; entities are decoded; white space in a line is one space and empty lines go.  A tag is
``<`` with a letter, ``/``, ``!`` or ``?`` up to the next ``>``, or ``<`` that follows; the work is linear in the
page.  Null pages are empty pages, null targets are missing headers; repeated rows give equal records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
HTTP_HEADERS = (("Content-Type", "text/html; charset=utf-8"),)

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|"
                    r"header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|td|th|title|tr|ul)\b[^<>]*>?", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>?")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\n ]*")
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_LINK = re.compile(r"<a\s[^<>]*?href\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join('' if n is None else str(n) for n in names))}>"


def plain_text(page: str) -> str:
    t = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    t = _SPACE.sub(" ", entities.unescape(t).replace("\r", "\n"))
    return _LINES.sub("\n", t).strip()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A whole record: version line, headers that are not null, length, block."""
    lines = ["WARC/1.1", *[f"{k}: {' '.join(v.split())}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
                       T.StructField("block_digest", T.StringType()), T.StructField("record", T.BinaryType())])
RESPONSE = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("target", T.StringType()),
                         T.StructField("date", T.StringType()), T.StructField("http_headers", T.StringType()),
                         T.StructField("payload", T.StringType()), T.StructField("payload_digest", T.StringType())])


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", out: str = "response",
              date: str = DATE) -> DataFrame:
    """``pages`` with ``out``: each page as a response record (id, target, date, HTTP headers, payload, digest)."""
    heads = "".join(f"{k}: {v}\r\n" for k, v in HTTP_HEADERS)

    def make():
        def work(ids, urls, texts):
            rows = []
            for i, u, t in zip(ids, urls, texts, strict=True):
                t = t or ""
                d = digest(t.encode("utf-8"))
                rows.append({"record_id": record_id("response", i, u, d), "target": u, "date": date,
                             "http_headers": heads, "payload": t, "payload_digest": d})
            return [rows]
        return work
    src = pages.withColumn("page id as text", F.col(page_id).cast("string"))
    return append_columns(src, ["page id as text", url, html], [(out, RESPONSE)], make, pages.columns)


def derivatives(rows: DataFrame, response: str = "response", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with ``metadata`` and ``conversion`` records, and ``title``, ``language``, ``links`` and ``plain`` text.

    A null response gives null records.
    """
    def make():
        def work(found):
            cols: list[list] = [[] for _ in range(6)]
            for r in found:
                for c, v in zip(cols, one(r) if r else (None,) * 6, strict=True):
                    c.append(v)
            return cols

        def one(r):
            page, source = r["payload"] or "", r["record_id"]
            text = plain_text(page)
            m = _TITLE.search(page)
            title = " ".join(entities.unescape(m[1]).split()) if m else None
            m = _LANG.search(page)
            lang = m[1] if m else None
            # Control characters are no part of a link: a line end would start another field.
            links = list(dict.fromkeys(_CONTROL.sub("", entities.unescape(a or b or c)) for a, b, c in _LINK.findall(page)))
            shared = [("WARC-Target-URI", r["target"]), ("WARC-Date", r["date"]), ("WARC-Refers-To", source),
                      ("WARC-Source-Payload-Digest", r["payload_digest"])]
            fields = [*[f"source-{line}" for line in (r["http_headers"] or "").split("\r\n") if line],
                      *[f"{k}: {v}" for k, v in (("title", title), ("language", lang)) if v],
                      *[f"outlink: {x}" for x in links], f"payload-bytes: {len(page.encode())}", f"text-characters: {len(text)}"]
            built = []
            for kind, mime, block in (("metadata", "application/warc-fields", "\r\n".join(fields).encode() + b"\r\n"),
                                      ("conversion", "text/plain; charset=utf-8", text.encode())):
                own, d = record_id(kind, source), digest(block)
                data = record([("WARC-Type", kind), ("WARC-Record-ID", own), *shared, ("WARC-Block-Digest", d),
                               ("Content-Type", mime)], block)
                built.append({"record_id": own, "refers_to": source, "block_digest": d, "record": data})
            return (*built, title, lang, links, text)
        return work
    return append_columns(rows, [response], [("metadata", RECORD), ("conversion", RECORD), ("title", T.StringType()),
                                             ("language", T.StringType()), ("links", T.ArrayType(T.StringType())),
                                             ("plain", T.StringType())], make, keep)


def derivative_table(pages: DataFrame) -> DataFrame:
    """Two rows a page: the metadata and the conversion record with ids, digests, sizes and the record's SHA-256."""
    src = pages.select("page_id", "url", "html")
    found = derivatives(responses(src).select("page_id", "url", "response"))
    rows = found.select("page_id", "url", F.col("response.payload_digest").alias("source_digest"), "title", "language",
                        F.size("links").alias("n_links"), F.length("plain").alias("n_chars"),
                        F.explode(F.array(F.struct(F.lit("metadata").alias("type"), F.col("metadata").alias("r")),
                                          F.struct(F.lit("conversion").alias("type"), F.col("conversion").alias("r")))).alias("x"))
    return rows.select("page_id", "url", "x.type", "x.r.record_id", "x.r.refers_to", "x.r.block_digest", "source_digest",
                       "title", "language", "n_links", "n_chars", F.octet_length("x.r.record").cast("long").alias("record_bytes"),
                       F.sha2("x.r.record", 256).alias("record_sha256"))
