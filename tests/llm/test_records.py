"""WARC derivatives and tool calls: linked records, canonical JSON, orders, edge cases."""

import base64
import hashlib
import json
import random
import time
from html.parser import HTMLParser

from swathkit.llm import chat, queries, warc


def parsed(record: bytes):
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)  # of repeated ones the last
    block = rest[: int(headers["Content-Length"])]
    assert first == "WARC/1.1" and rest == block + b"\r\n\r\n"
    return headers, block


def test_records_of_pages(spark, data):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    made = warc.derive(warc.responses_of_pages(spark.read.parquet(f"{data}/pages.parquet"))).collect()
    assert len(made) == 2 * len(pages)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in made:
        headers, block = parsed(bytes(r["record"]))
        page = pages[r["source_id"]]
        assert headers["WARC-Type"] == r["record_type"] and headers["WARC-Refers-To"] == r["refers_to"]
        assert headers["WARC-Source-Payload-Digest"] == sha((page["html"] or "").encode()) and headers["WARC-Block-Digest"] == sha(block)
        if r["record_type"] == "metadata":
            assert b"source-header: HTTP/1.1 200 OK\r\n" in block
    assert len({r["record_id"] for r in made}) == len(made)
    assert queries.op6_warc_derivatives(spark, data).count() == len(made)


def test_plain_text():
    page = "<!DOCTYPE html><html lang=en><head><title>A &amp; B</title><style>x{}</style></head><body><!-- no --><p>One  <b>two</b></p><script>bad()</script>a &lt; b<br>c<a href='/x'>go</a></body></html>"
    assert warc.plain_text(page) == "A & B\nOne two\na < b\ncgo"
    assert warc.page_metadata(page) == [("title", "A & B"), ("language", "en"), ("outlink", "/x")]
    assert warc.plain_text("<script>never closed") == warc.plain_text("") == ""


def test_warc_edges(spark):
    rows = [(1, "<urn:uuid:a>", None, None, None, None), (None, None, "http://x/ y", "2024-01-01T00:00:00Z", "A: b\r\n\r\nC: d", "<p>x</p>" * 50_000), (2, "<urn:uuid:b>", "u", "d", "h", "x"), (2, "<urn:uuid:b>", "u", "d", "h", "x")]
    df = spark.createDataFrame(rows, "source_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string")
    got = warc.derive(df).collect()
    assert len(got) == 8 and all(parsed(bytes(r["record"])) for r in got)
    assert warc.derive(df.limit(0)).count() == 0


def test_calls_equal_sql(spark, data, duck, same_rows):
    got = queries.op7_tool_calls(spark, data)
    want = duck.execute(queries.ORACLE_SQL["op7_tool_calls"])
    assert same_rows(got.columns, [tuple(r) for r in got.collect()]) == same_rows([d[0] for d in want.description], want.fetchall())


def test_links_and_levels(spark):
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "f", '{"x": 1}', None, "z"), (1, "b", 1, "f", '{"x": 0}', ["a"], "z"), (1, "c", 2, "f", "not json", ["b", "a", "missing"], "z"), (1, "d", 3, "g", '{"x": 1}', ["e"], "z"), (1, "e", 4, "f", '{"x": true}', ["d"], "z"),
            (2, "a", 0, "f", '{"x": 2, "y": 1}', [], "z"), (1, "a", 9, "f", '{"x": 7}', None, "z"), (None, "q", 0, "f", "{}", None, "z"), (3, None, 0, "f", "{}", None, "z"), (4, "n", 0, None, None, None, "z"),
        ],
        "conv_id long, call_id string, seq int, name string, arguments string, depends_on array<string>, content string",
    )
    results = spark.createDataFrame([(1, "a", 5, "r\"é", 1), (1, "a", 6, "later", 1), (7, "z", 0, "orphan", 1), (1, "c", 7, None, 1)], "conv_id long, call_id string, seq int, content string, name int")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(calls, results, schema).collect()}
    assert len(got) == 8
    assert {k[1]: (r["level"], r["status"], r["valid"]) for k, r in got.items() if k[0] == 1} == {
        "a": (0, "linked", True), "b": (2, "unanswered", False), "c": (4, "linked", False), "d": (None, "unanswered", False), "e": (None, "unanswered", False),
    }
    assert got[(1, "a")]["linked_json"] == '{"arguments":{"x":1},"id":"a","name":"f","result":"r\\"é"}'
    assert got[(7, "z")]["status"] == "orphan" and not got[(7, "z")]["valid"] and not got[(2, "a")]["valid"] and not got[(4, "n")]["valid"]
    assert all(json.loads(r["linked_json"])["id"] == k[1] for k, r in got.items())
    assert chat.link(calls.limit(0), results.limit(0), schema).count() == 0


def test_schemas():
    assert chat.fits([1, 2], {"type": "array", "items": {"type": "integer"}}) and not chat.fits([1, "a"], {"type": "array", "items": {"type": "integer"}})
    assert not chat.fits(True, {"type": "number"}) and chat.fits(2.0, {"type": "integer"}) and chat.fits(None, {"type": ["string", "null"]})
    assert not chat.fits("x", {"enum": ["a"]}) and not chat.fits("abc", {"maxLength": 2})


class Reader(HTMLParser):
    """The text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped, self.parts, self.links = [], [], []

    def handle_starttag(self, tag, attrs):
        if not self.skipped and tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(" ".join(dict(attrs)["href"].split()))
        if tag in warc._SKIPPED:
            self.skipped.append(tag)
        elif not self.skipped and tag in warc._BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()
        elif not self.skipped and tag in warc._BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def words_and_links(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.parts).split(), reader.links


def test_text_equals_another_parser(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        words, links = words_and_links(r["html"] or "")
        assert warc.plain_text(r["html"] or "").split() == words
        assert [v for k, v in warc.page_metadata(r["html"] or "") if k == "outlink"] == links


def test_hard_pages_take_one_pass():
    began = time.time()
    for piece in ("<!--", "<title", "<a", "<a href=", "<script", "<script></script", "<", "</", "&#", "&", "<!doctype", "<title>", "-->", "<svg>", "href = "):
        page = piece * (5_000_000 // len(piece))
        warc.plain_text(page)
        warc.page_metadata(page + ">")
    assert time.time() - began < 60
    assert warc.plain_text("a<!-- never closed <p>b") == "a" and warc.plain_text("1 < 2 <b>c</b> <d") == "1 < 2 c <d"
    assert warc.plain_text("&#" + "9" * 5000 + ";x&#" + "0" * 5000 + "65;") == "\ufffdxA"


def test_given_digests_and_headers_are_kept(spark):
    df = spark.createDataFrame([(1, "<urn:uuid:a>", "u", "d", "HTTP/1.1 200 OK\r\nServer: x", "<p>x</p>", "sha1:GIVEN")], "source_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string")
    for r in warc.derive(df).collect():
        assert r["payload_digest"] == "sha1:GIVEN" and b"WARC-Source-Payload-Digest: sha1:GIVEN" in r["record"] and b"WARC-Source-Header: Server: x" in r["record"]


def brute_depths(deps):
    """call -> depth by repeated passes; none in a cycle or behind one."""
    depth = {}
    while True:
        new = {c: 1 + max(depth[d] for d in ds if d in deps) if any(d in deps for d in ds) else 0 for c, ds in deps.items() if c not in depth and all(d in depth for d in ds if d in deps)}
        if not new:
            return {c: depth.get(c) for c in deps}
        depth |= new


def test_levels_equal_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for conv in range(6):
        deps = {}
        for k in range(60):
            n = rng.choice([0, 1, 1, 1, 1, 2, 3]) if k else 0
            pool = range(k) if conv < 4 else range(60)  # the last ones have cycles
            deps[f"c{k}"] = sorted({f"c{rng.choice(pool)}" for _ in range(n)}) + ["unknown"] * (k % 7 == 0)
        want |= {(conv, c): d for c, d in brute_depths(deps).items()}
        rows += [(conv, c, ds) for c, ds in deps.items()]
    long = {f"r{k}": [f"r{k - 1}"] if k else [] for k in range(3000)}
    rows += [(9, c, ds) for c, ds in long.items()]
    want |= {(9, f"r{k}"): k for k in range(3000)}
    got = chat.call_levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()
    assert {(r["conv_id"], r["call_id"]): r["depth"] for r in got} == want and len(got) == len(want)


def test_odd_arguments(spark):
    odd = ['{"x": "\\ud800"}', "1" * 400, "[" * 100_000, '{"x": NaN}', '{"x": 1e400}', "9" * 6000, '{"x": 1' + "0" * 400 + "}", None, ""]
    calls = spark.createDataFrame([(1, f"c{k}", k, "f", a, None) for k, a in enumerate(odd)], "conv_id long, call_id string, seq int, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, seq int, content string")
    schema = {"f": {"type": "object", "properties": {"x": {"type": ["integer", "string"]}}}}
    got = {int(r["call_id"][1:]): r for r in chat.link(calls, results, schema).collect()}
    assert [got[k]["valid"] for k in range(9)] == [True, False, False, False, False, False, True, False, False]
    for k, r in got.items():
        told = json.loads(r["linked_json"], parse_constant=lambda x: 1 / 0) if k not in (2,) else json.loads(r["linked_json"])
        assert told["id"] == f"c{k}"
    assert "\ufffd" in got[0]["linked_json"] and json.loads(got[4]["linked_json"])["arguments"] == odd[4]
