"""WARC derivatives: linked metadata and plain-text conversion records of response records.

For each response two records are built. Both name the response in WARC-Refers-To (with its target and date in
WARC-Refers-To-Target-URI and -Date) and keep its payload digest and source headers; each has a block digest of its
own. Record ids follow from the response's id, so a repeated run makes the same records. Rows are built in Arrow
batches where they lie; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VERSION = "WARC/1.1"
# Fixed values of HTML: elements without text to read, and elements that break a line.
_SKIPPED = {"script", "style", "noscript", "template", "svg"}
_BREAKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr title ul".split())
_TOKEN = re.compile(r"<!--|<(?:!doctype|(/?)([a-z][^\s/>]*))[^>]*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in _SKIPPED}
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_TOO_LARGE = re.compile(r"&#[0-9]{8,};?")


def unescape(text: str) -> str:
    """Character references resolved; those of no character, however long, become U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_TOO_LARGE.sub("\ufffd", _ZEROS.sub("&#", text)))


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    """The id of a record derived from another one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {kind}')}>"


def read_page(source: str) -> tuple[str, list[tuple[str, str]]]:
    """The text of a page and the fields of its metadata block, in one forward pass.

    The text is without scripts, styles and comments, a line for each block, spaces run together; the fields are title,
    language and outlinks, in the order of the page. A comment or a skipped element that isn't closed goes to the end of
    the page; a ``<`` that no ``>`` follows is text. So no part of a page is searched twice.
    """
    parts: list[str] = []
    title: list[str] | None = None
    titled, language, links = False, None, []
    at, last = 0, source.rfind(">") + 1
    while m := _TOKEN.search(source, at, last):
        start, end = m.span()
        if start > at:
            parts.append(source[at:start])
            if title is not None and not titled:
                title.append(parts[-1])
        name = (m[2] or "").lower()
        if not name:
            parts.append(" ")
            if source.startswith("<!--", start):
                end = source.find("-->", end) + 3
                if end < 3:
                    end = len(source)
        elif name in _SKIPPED and not m[1]:
            parts.append(" ")
            close = _CLOSES[name].search(source, end)
            end = close.end() if close else len(source)
        else:
            if name in _BREAKS:
                parts.append("\n")
            if name == "title" and not titled:
                if not m[1]:
                    title = title or []
                elif title is not None:
                    titled = True
            elif not m[1] and name == "a":
                if link := _HREF.search(source, start, end):
                    links.append(("outlink", " ".join(unescape(link[1] or link[2] or link[3] or "").split())))
            elif not m[1] and name == "html" and language is None and (found_lang := _LANG.search(source, start, end)):
                language = found_lang[1]
        at = end
    rest = source[at:]
    parts.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    lines = (" ".join(x.split()) for x in unescape("".join(parts)).split("\n"))
    out = [("title", " ".join(unescape("".join(title)).split()))] if titled else []
    return "\n".join(x for x in lines if x), out + ([("language", language)] if language else []) + links


def plain_text(source: str) -> str:
    return read_page(source)[0]


def page_metadata(source: str) -> list[tuple[str, str]]:
    return read_page(source)[1]


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a file."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build(record_id: str, uri: str | None, date: str, headers: str | None, payload: str | None, known: str | None = None) -> list[dict]:
    """The metadata and the conversion record of one response; ``known`` is the digest that the response itself gives."""
    page, uri = payload or "", " ".join((uri or "").split())
    source = known or digest(page.encode())
    text, told = read_page(page)
    given = [" ".join(h.split()) for h in (headers or "").splitlines() if h.strip()]
    fields = [("payload-digest", source), *(("source-header", h) for h in given), *told]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()),
        "conversion": ("text/plain; charset=utf-8", text.encode()),
    }
    out = []
    for kind, (content_type, block) in blocks.items():
        own = derived_id(record_id, kind)
        head = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", record_id),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", source), *(("WARC-Source-Header", h) for h in given),
            ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block))),
        ]
        out.append({"record_type": kind, "record_id": own, "refers_to": record_id, "target_uri": uri, "content_type": content_type, "payload_digest": source, "block_digest": digest(block), "block": block.decode(), "record": record_bytes(head, block)})
    return out


_KINDS = {"record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "content_type": pa.string(), "payload_digest": pa.string(), "block_digest": pa.string(), "block": pa.string(), "record": pa.binary()}
SCHEMA = "source_id {id}, record_type string, record_id string, refers_to string, target_uri string, content_type string, payload_digest string, block_digest string, block string, record binary"


def derive(responses: DataFrame) -> DataFrame:
    """Two rows (metadata, conversion) for each response row.

    ``responses``: source_id, record_id, target_uri, warc_date, http_headers, payload and, if it has one, payload_digest,
    which is kept. A null payload counts as empty (an empty conversion block), a null URI too; a null record id gives a
    row's records the id of an empty one. Payloads of any length are read once, whole. Repeated rows repeat their records;
    other columns are ignored; an empty table gives none.
    """
    known = F.col("payload_digest") if "payload_digest" in responses.columns else F.lit(None)
    common.by_bytes(responses.sparkSession)
    rows = responses.select("source_id", "record_id", "target_uri", "warc_date", "http_headers", "payload", known.cast("string").alias("payload_digest"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, made = [], []
            for r in batch.to_pylist():
                own = build(r["record_id"] or "", r["target_uri"], r["warc_date"] or "", r["http_headers"], r["payload"], r["payload_digest"])
                made += own
                ids += [r["source_id"]] * len(own)
            columns = [pa.array([m[k] for m in made], t) for k, t in _KINDS.items()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *columns], names=["source_id", *_KINDS])

    return rows.mapInArrow(batches, SCHEMA.format(id=rows.schema["source_id"].dataType.simpleString()))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html); ids follow from page and address."""
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.col("url")).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    return pages.select(F.col("page_id").alias("source_id"), urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_headers"), F.col("html").alias("payload"))
