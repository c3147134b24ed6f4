"""Script-drawn pages and their fallbacks; recently used pages, refreshes, announcements."""

import datetime

from pagegrain.functions.shell import alternates, hints, linked_data, noscript_article, read
from pagegrain.operators.fallback import cacheable, read_pages, with_fallbacks
from pagegrain.operators.memory import announcements, recent_pages, refreshed

U = "https://a.example/p/"
SHELL = '<head><title>T</title><meta name="description" content="What it is."></head><body><div id="root"></div><script src="x.js"></script>{}</body>'


def test_hints():
    page = SHELL.format('<noscript>Enable JavaScript<p>Real words here</p><p>real  WORDS</p></noscript><script type="application/ld+json">{"@graph": [{"articleBody": "Body"}, {"description": "untyped"}, {"@type": "X", "description": "Sum"}]}</script><script type="application/ld+json">{bad</script>')
    assert hints(page) == (["Real words here", "Body", "What it is.", "Sum"], True)
    assert hints("<body><p>" + "word " * 50 + "</p></body>") == ([], False)
    assert linked_data([{"@type": None, "description": "no"}, 3, "x"]) == ([], [])
    got = read(page, U)
    assert got["is_shell"] and got["markdown"].startswith("> **This page draws") and "Sum" in got["markdown"]
    whole = "<h1>Head</h1><p>" + "word " * 200 + "</p>"
    assert noscript_article(f"<body><noscript>{whole}</noscript></body>") == whole
    got = read(SHELL.format(f"<noscript>{whole}</noscript>"), U)
    assert not got["is_shell"] and got["markdown"].startswith("# Head") and got["body_words"] == 200
    assert read(None, None)["body_words"] == 0


def test_alternates():
    link = '<link rel="alternate" type="text/markdown" href="{}"><link rel="amphtml" href="/amp">'
    assert alternates(link.format("x.md"), U) == (U + "x.md", "https://a.example/amp")
    assert alternates(link.format("http://10.0.0.1/x.md"), U)[0] is None
    assert alternates(link.format("http://10.0.0.1/x.md"), "http://localhost/")[0] == "http://10.0.0.1/x.md"
    assert alternates(link.format("file:///etc/x"), U)[0] is None and alternates(link.format("llms.txt"), U)[0] is None


def test_fallback_chain(spark):
    ddl = "page_id bigint, url string, html string"
    amp = '<link rel="amphtml" href="/amp{}">'
    text = lambda n: "<body><p>" + "word " * n + "</p></body>"
    pages = spark.createDataFrame([(1, U + "1", SHELL.format(amp.format(1))), (2, U + "2", SHELL.format(amp.format(2))), (3, U + "3", text(50)), (4, None, None), (5, U + "5", SHELL.format(""))], ddl)
    versions = spark.createDataFrame([(1, "https://a.example/amp1", text(90)), (2, "https://a.example/amp2", text(1)), (3, None, None)], ddl)
    rendered = spark.createDataFrame([(1, U + "1", text(99)), (2, U + "2", text(60)), (3, U + "3", text(99)), (5, U + "5", text(2))], ddl)
    got = {r.page_id: (r.version, r.is_shell) for r in with_fallbacks(pages, versions, rendered).collect()}
    assert got == {1: ("amp", False), 2: ("drawn", False), 3: ("page", False), 4: ("page", False), 5: ("page", True)}
    assert {r.page_id for r in cacheable(read_pages(pages)).collect()} == {3}
    assert with_fallbacks(pages.limit(0), versions, rendered).count() == 0
    assert with_fallbacks(pages, versions.limit(0), rendered.limit(0)).count() == 5


def test_recent_pages(spark):
    url = "http://x/{}".format
    rows = [(1, 0, url("a"), 40), (1, 1, url("b"), 40), (1, 2, url("a"), 40), (1, 3, url("c"), 40), (1, 4, url("b"), 10), (1, 5, url("d"), 101), (1, 6, "file:///x", 1), (2, 0, None, None), (None, 0, url("a"), 5)]
    got = {(r.session, r.seq): (r.hit, r.n_kept, r.kept_bytes, r.evicted) for r in recent_pages(spark.createDataFrame(rows, "session bigint, seq bigint, url string, size int"), pages=3, room=100).collect()}
    assert got[1, 2] == (True, 2, 80, []) and got[1, 3] == (False, 2, 80, [url("b")])
    assert got[1, 4] == (False, 3, 90, []) and got[1, 5] == (False, 3, 90, []) and got[1, 6][1] == 3
    assert got[2, 0] == (False, 0, 0, []) and got[None, 0][1] == 1


def test_refresh_and_announce(spark):
    now = datetime.datetime(2024, 1, 31)
    ago = lambda s: now - datetime.timedelta(seconds=s)
    cached = spark.createDataFrame([("a", "x", ago(10)), ("b", "x", ago(900)), ("c", "x", ago(40 * 86400)), ("d", None, ago(900))], "url string, content string, saved timestamp")
    fetched = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "")], "url string, content string")
    assert sorted(map(tuple, refreshed(cached, fetched, now).collect())) == [("a", "fresh", False), ("b", "stale", True), ("c", "expired", False), ("d", "stale", False)]
    checks = spark.createDataFrame([(1, 0, "1"), (1, 1, "1"), (1, 2, "2"), (2, 0, None), (2, 5, "1")], "session bigint, seq bigint, version string")
    assert sorted(map(tuple, announcements(checks).collect())) == [(1, 0, "1"), (1, 2, "2"), (2, 5, "1")]
