"""URL, HTML, scoring, robots and hash functions on cases written by hand."""

import pytest
from pyspark.sql import functions as F

from weir.functions import documents, formats, hashing, robots, scoring, telemetry
from weir.functions import html as H
from weir.functions import url as U


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Ex.com:80/a/../b/?utm_source=x&b=2&a=1#f", "http://ex.com/b/?a=1&b=2"),
        ("https://ex.com:8443", "https://ex.com:8443/"),
        ("https://ex.com/a b/%C4%8D?x=&ref=1", "https://ex.com/a%20b/%C4%8D?x="),
        ("mailto:x@y", None),
        ("ftp://h/", None),
        ("/relative", None),
        ("http://ex.com:port/", None),
    ],
)
def test_canonical(raw, want):
    assert U.canonical(raw) == want


def test_canonical_with_base(spark):
    assert value(spark, U.canonicalize(F.lit("../c?d#e"), F.lit("https://EX.com/a/b/"))) == "https://ex.com/a/c?d="
    assert value(spark, U.canonicalize(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("url", "want"), [("https://h/dl?file=report.DOCX", "DOCX"), ("https://h/a.pdf#x", "PDF"), ("https://h/a.pptx?v=1", "PPTX"), ("https://h/get?x.doc", "DOC"), ("https://h/pdf", None), ("https://h/?q=%22a.pdf%22", "PDF")])
def test_document_type(spark, url, want):
    assert value(spark, U.document_type(F.lit(url))) == want


def test_types_of_responses_and_bytes(spark):
    assert value(spark, U.document_type_of_response(F.lit("https://h/x"), F.lit("application/octet-stream"), F.lit('attachment; filename="a.pdf"'))) == "PDF"
    assert value(spark, U.document_type_of_response(F.lit("https://h/x"), F.lit("Application/PDF; q=1"), F.lit(None).cast("string"))) == "PDF"
    assert value(spark, U.sniffed_type(F.unhex(F.lit("89504E470D0A1A0A0000")), F.lit("x"))) == "image/png"
    assert value(spark, U.sniffed_type(F.unhex(F.lit("00")), F.lit("x"))) == "x"
    assert value(spark, U.srcset_urls(F.lit("a.png 1x, b.png 2x, #c"))) == ["a.png", "b.png"]


@pytest.mark.parametrize(("host", "want"), [("www.nijz.gov.si", "nijz.gov.si"), ("a.b.example.com", "example.com"), ("si", "si"), ("", "unknown"), ("a.example.si", "example.si")])
def test_registrable_domain(spark, host, want):
    assert value(spark, U.registrable_domain(F.lit(host))) == want


def test_html_assets():
    page = """<a href="/x.png">i</a> <a href="/l?b=1&amp;a=2">l</a> <a href="#f">f</a> <a href="mailto:a@b">m</a> <a href="/l?a=2&b=1">again</a>
    <img data-src="/d.gif"><img src="" srcset="/a.png 1x, /b.png 2x"><source src="/s.webp"><button onclick="window.open('/p')">p</button> <div onclick='location.href="/q"'>q</div>"""
    got = H.assets(page, "https://ex.com/dir/")
    assert got["links"] == ["https://ex.com/l?a=2&b=1", "https://ex.com/p", "https://ex.com/q"]
    assert got["images"] == ["https://ex.com/d.gif", "https://ex.com/a.png", "https://ex.com/b.png", "https://ex.com/s.webp", "https://ex.com/x.png"]
    assert got["js_links"] == ["https://ex.com/p", "https://ex.com/q"]
    assert H.assets(None, None) == {"links": [], "images": [], "js_links": []}


def test_crawler_score(spark):
    policy = scoring.Policy(keywords=["health"], suffixes=["gov.si"])
    score = lambda url, parent, depth: value(spark, scoring.crawler_score(F.lit(url), F.lit(parent), F.lit(depth), policy))
    assert score("https://a.com/x", "https://a.com/", 3) == pytest.approx(9.4)
    assert score("https://b.com/x", "https://a.com/", 3) == pytest.approx(-0.6)
    assert score("https://www.gov.si/health?health", None, 0) == pytest.approx(25)
    assert score("ftp://x", None, 0) == 0
    floor = scoring.page_score(F.lit("https://b.com/x"), F.lit("https://a.com/"), F.lit(3), policy)
    assert value(spark, floor) == 0
    assert value(spark, scoring.site_score(F.lit(10.0), F.lit(20.0), F.lit(9))) == pytest.approx(14.5)
    assert value(spark, scoring.backlink_score(F.lit(9))) == pytest.approx(10)


@pytest.mark.parametrize(
    ("content", "url", "want"),
    [
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "https://h/a/b/c", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "https://h/a", True),
        ("User-agent: *\nDisallow: /a$ # exact", "https://h/a/b", True),
        ("User-agent: *\nDisallow: /a$", "https://h/a", False),
        ("User-agent: x\nDisallow: /", "https://h/a", None),
        (None, "https://h/a", None),
    ],
)
def test_robots(content, url, want):
    assert robots.wildcard_verdict(content, url)[0] is want


def test_robots_policy(spark):
    got = value(spark, robots.robots_policy(F.lit("User-agent: *\nCrawl-delay: 7\nDisallow: /x\nSitemap: https://h/s.xml"), F.lit("bot"), F.lit("https://h/x")))
    assert (got.allowed, got.crawl_delay, got.sitemaps) == (False, 7.0, ["https://h/s.xml"])
    assert value(spark, robots.robots_policy(F.lit(None).cast("string"), F.lit("bot"), F.lit("https://h/x"))).allowed


def test_hashes(spark):
    assert hashing.fnv64("", hashing.SLOT_BASIS) == hashing.SLOT_BASIS
    assert hashing.fnv64("a", hashing.SLOT_BASIS) == 0xAF63DC4C8601EC8C
    assert hashing.fnv32("a") == pytest.approx(0xE40C292C / 2**32)
    assert value(spark, hashing.decoded_base64(F.lit("!!"))) is None


def test_telemetry(spark):
    assert value(spark, telemetry.terminal_state(F.lit(" queued "))) == "QUEUED"
    assert value(spark, telemetry.level(F.lit("fetch-failed"), F.lit("{}"))) == "Error"
    assert value(spark, telemetry.metrics(F.lit("worker-metric"), F.lit('{"a": 1, "b": "x", "c": 2.5}'))) == {"a": 1.0, "c": 2.5}
    assert value(spark, telemetry.metric_increment(F.lit('{"type":"page-reported"}'))) == 1.0


def merged(spark, base, over):
    doc = lambda text: documents.document(F.lit(text))
    return value(spark, F.to_json(documents.merged(doc(base), doc(over))))


def test_merged_documents_keep_their_types(spark):
    assert merged(spark, '{"a":1,"n":{"x":[1,2.50,null]},"t":true}', '{"b":"2","n":{"y":1}}') == '{"a":1,"b":"2","n":{"y":1},"t":true}'
    assert merged(spark, '{"a":1.50}', '{"a":null}') == '{"a":null}'
    assert merged(spark, None, '{"a":[{}]}') == merged(spark, "no json", '{"a":[{}]}') == merged(spark, "[1]", '{"a":[{}]}') == '{"a":[{}]}'
    assert merged(spark, "{}", " ") == "{}"


def test_typed_documents_fall_back_as_a_whole(spark):
    fields, usual = "k int, d struct<os: string>", F.struct(F.lit(7).alias("k"), F.struct(F.lit("none").alias("os")).alias("d"))
    got = lambda text: value(spark, F.to_json(documents.typed(F.lit(text), fields, usual)))
    assert got('{"k": 3, "d": {"os": "ios", "ver": 2}, "more": []}') == '{"k":3,"d":{"os":"ios"}}'
    assert got('{"d": {}}') == '{"d":{}}'
    for other in ('{"k": "three"}', '{"k": "3"}', '{"k": 3, "d": 5}', "[]", "{", "", None):
        assert got(other) == '{"k":7,"d":{"os":"none"}}'


def test_fields_as_text(spark):
    at = lambda path: value(spark, documents.text_at(documents.document(F.lit('{"a":" ","b":2,"c":{"d":true},"e":null}')), path))
    assert [at(p) for p in ("$.a", "$.b", "$.c", "$.c.d", "$.e", "$.f")] == [None, "2", '{"d":true}', "true", None, None]


def test_formats(spark):
    got = lambda c: value(spark, c)
    share = lambda part, whole: got(formats.percent(F.lit(part), F.lit(whole)))
    assert [share(1, 16), share(3, 2), share(0, 4), share(1, 0), share(30, 2)] == ["6.3%", "150.0%", "0.0%", "0%", "1500.0%"]
    size = lambda n: got(formats.byte_size(F.lit(n).cast("long")))
    assert [size(n) for n in (0, 1023, 1024, 1536, 1048576, 5 * 1024**3, 2000 * 1024**3, None)] == ["0 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "5 GB", "2000 GB", None]
    left = lambda ms: got(formats.remaining(F.lit(ms).cast("long")))
    assert [left(ms) for ms in (-5, 0, 1, 1001, 59999, 60000, 61999, 7_200_000)] == ["0s", "0s", "1s", "2s", "60s", "1m 0s", "1m 1s", "120m 0s"]
    age = lambda ms: got(formats.lock_age(F.lit(ms).cast("long")))
    assert [age(ms) for ms in (None, -3, 1500, 120_000)] == ["lock time n/a", "locked 1s ago", "locked 2s ago", "locked 2m ago"]
    short = lambda level: got(formats.short_severity(F.lit(level)))
    assert [short(x) for x in ("Warning", "information", "DEBUG", "Error", "ok")] == ["WRN", "INF", "DBG", "ERR", "OK"]


def test_names_and_types_of_files(spark):
    name = lambda header: value(spark, U.disposition_name(F.lit(header)))
    assert [name(h) for h in ("attachment; filename*=UTF-8''a%20b+c.pdf", 'inline; filename="x y.doc"; size=3', "attachment", "filename='q.ppt'")] == ["a b+c.pdf", "x y.doc", "", "q.ppt"]
    kind = lambda code, data: value(spark, U.stored_content_type(F.lit(code).cast("string"), F.lit(data)))
    assert kind(" pptx", b"") == "application/vnd.openxmlformats-officedocument.presentationml.presentation"
    assert [kind(None, x) for x in (b"GIF87a", b"GIF88a", b"%PDF-1", b"%PDF", b"RIFF1234WEBPx", b"")] == ["image/gif", "application/octet-stream", "application/pdf", "application/octet-stream", "image/webp", "application/octet-stream"]
    assert [value(spark, U.file_extension(F.lit(m))) for m in ("Image/JPEG", "application/msword", "text/html")] == [".jpg", ".doc", ".bin"]
    assert [value(spark, U.image_content_type(F.lit(u))) for u in ("https://a/b.TIFF?c=d.png", "https://a/b.pdf", "https://a/.svg#x")] == ["image/tiff", None, "image/svg+xml"]
