"""The tool surface on small tables."""

import datetime

import pytest

from pagegrain.engine import Engine
from pagegrain.sources import files

AT = datetime.datetime(2024, 1, 1)
PAGE = '<title>T</title><body><h1>H</h1><p>see <a href="/x">one</a>, <a href="/y">two</a>, <a href="/x">again</a> and <a href="mailto:a@b">m</a></p></body>'


@pytest.fixture
def engine(spark):
    return Engine(spark)


def test_reading(spark, engine):
    pages = spark.createDataFrame([(1, "https://a.example/p", PAGE), (2, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in engine.read(pages, strip_links=True).collect()}
    assert got[1].markdown == "# H\n\nsee one, two, again and m" and got[1].bytes == len(got[1].markdown) and got[2].markdown == ""
    assert [(r.ord, r.text, r.href, r.kind) for r in engine.links(pages).orderBy("ord").collect()] == [(1, "one", "https://a.example/x", "web"), (2, "two", "https://a.example/y", "web"), (3, "m", "mailto:a@b", "unsupported")]
    assert [(r.page_id, r.lines, r.headings, r.text) for r in engine.render(pages).collect()] == [(1, 3, 1, "H\n\nsee one, two, again and m")]
    typed = spark.createDataFrame([("a.example",), ("x y",)], "input string")
    assert [(r.target, r.is_search) for r in engine.resolve_input(typed, engine="https://s.example/?q=%s&z").collect()] == [("https://a.example", False), ("https://s.example/?q=x+y&z", True)]


def test_state(spark, engine):
    ddl = "url string, title string, at timestamp, pos int"
    visits = spark.createDataFrame([("a", "Alpha", AT, 0), ("b", None, AT, 1), ("a", "Again", AT, 2), ("c", "C", AT, 3)], ddl)
    assert [(r.url, r.title) for r in engine.history(visits, 2, "A").collect()] == [("a", "Again")]
    assert [r.url for r in engine.history(visits, 0).collect()] == ["c", "a", "b"] and engine.history(visits, 1, "a").count() == 0
    marks = visits.where("pos < 2")
    assert [r.url for r in engine.bookmarks(marks).collect()] == ["b", "a"]
    assert [r.url for r in engine.bookmark_toggle(marks, "a", "A", AT).collect()] == ["b"]
    assert sorted((r.url, r.pos) for r in engine.bookmark_toggle(marks, "z", "Z", AT).collect()) == [("a", 0), ("b", 1), ("z", 2)]
    assert [r.pos for r in engine.bookmark_toggle(engine.clear(marks), "z", "Z", AT).collect()] == [0]
    assert engine.delete(visits, "a").count() == 2


def test_cache_and_settings(spark, engine):
    cache = spark.createDataFrame([("https://a.example/p", "old", AT)], "url string, content string, saved timestamp")
    pages = spark.createDataFrame([(1, "https://a.example/p", PAGE), (2, "file:///x", PAGE)], "page_id bigint, url string, html string")
    put = engine.cache_put(cache, pages, AT)
    assert [r.content[:3] for r in put.collect()] == ["# H"] and engine.cache_stats(put.limit(0)).head() == (0, 0) and engine.cache_stats(cache).head() == (1, 3)
    config = files.settings(spark, "", {"width": 80, "cache": True})
    assert {r.name: r.value for r in engine.config_set(config, {"width": 90}).collect()} == {"width": "90", "cache": "true"}
    for bad in ({"no": 1}, {"width": "x"}, {"cache": 1}):
        with pytest.raises(ValueError):
            engine.config_set(config, bad)
