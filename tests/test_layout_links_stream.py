"""Layout invariants, link resolution, and stream against batch."""

from pagegrain.functions.layout import cells, lines, spans, wrap
from pagegrain.functions.links import resolve
from pagegrain.functions.tokens import tokens
from pagegrain.operators.extraction import code_blocks, highlighted
from pagegrain.operators.sessions import replay
from pagegrain.streaming.replay import replay_stream


def test_lines_fit():
    blocks = [("heading", "# A title"), ("paragraph", "word " * 60 + "[link](http://x.example) " + "x" * 90), ("list", "- one\n- **two** " + "w " * 40), ("code", "```py\n\tlong = 1" + "0" * 90 + "\n```"), ("table", "| a | b |\n| --- | --- |\n| " + "w " * 60 + "| 2 |"), ("rule", "---")]
    for width in (20, 40, 80):
        got = lines(blocks, width)
        assert all(cells(t) <= width for _, _, t in got)
        assert not any("](" in t or "**" in t for _, _, t in got)
    assert wrap("漢字 漢字", 4) == ["漢字", "漢字"] and wrap("", 5) == []


def test_resolve():
    base = "https://a.example/x/y?q=1"
    assert resolve(base, "../z") == ("https://a.example/z", True)
    assert resolve(base, "#top") == ("#top", True)
    assert resolve(base, " ") == (None, False) and resolve(base, None) == (None, False)
    assert resolve(base, "mailto:x@y")[1] is False and resolve(base, "file:///etc/passwd")[1] is False
    assert resolve("file:///a/b.md", "c.md") == ("file:///a/c.md", True)
    assert resolve(base, "//b.example/p") == ("https://b.example/p", True)


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["push", "push", "back", "forward", "replace", "fail", "push", "back"]
    rows = [(s, i, kinds[(i + s) % 8], f"/{s}/{i}") for s in range(5) for i in range(20)]
    schema = "session bigint, seq bigint, kind string, url string"
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    want = replay(spark.createDataFrame(rows, schema))
    assert sorted(spark.table("replayed").collect()) == sorted(want.collect())


def test_link_spans():
    blocks = [("paragraph", "see [one two three four](http://a) and [b](http://b), [again](http://a)"), ("code", "```\n[x](y)\n```"), ("list", "- [c](http://c)")]
    got = spans(blocks, 16)
    shown = [t for _, _, t in lines(blocks, 16)]
    assert [(n, shown[n][a:b], k, t) for n, a, b, k, t in got] == [(0, "one two", 1, "http://a"), (1, "three four", 1, "http://a"), (2, "b", 2, "http://b"), (2, "again", 1, "http://a"), (8, "c", 3, "http://c")]


def test_highlighting(spark):
    code = 'def f(x):  # note\n    return "a" + 1\n'
    assert "".join(t for _, t in tokens(code)) == code and ("keyword", "return") in tokens(code) and tokens("") == []
    page = f"<pre><code>{code}</code></pre>"
    pages = spark.createDataFrame([(1, "http://a", page), (2, "http://b", page), (3, None, None)], "page_id bigint, url string, html string")
    rows = highlighted(code_blocks(pages)).collect()
    assert [r.page_id for r in sorted(rows)] == [1, 2] and all("".join(t.text for t in r.tokens) == r.code for r in rows)
    assert [(r.lang, r.guessed) for r in rows] == [("", False)] * 2
