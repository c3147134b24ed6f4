"""Properties of extraction and of session replay on small inputs."""

from pagegrain.functions.html import code_language, converted, extract, fence, has_junk_class, parse, trimmed
from pagegrain.operators.sessions import step


def md(html):
    return extract(html, "http://site.example/a/b")["markdown"]


def test_article_without_furniture():
    out = md("<title>T</title><nav>menu</nav><article><h1>Head</h1><p>some <b>bold</b> words<p>next<script>x('</p>')</script></article><footer>foot</footer>")
    assert out == "# Head\n\nsome **bold** words\n\nnext"


def test_title_only_without_heading():
    assert md("<title>T &amp; U</title><body><p>text</p></body>").startswith("# T & U\n\n")
    assert md("<title>T</title><pre># no heading</pre>").startswith("# T\n\n```")


def test_small_article_loses_to_page():
    page = "<body><article>one two</article><p>" + "word " * 50 + "</p></body>"
    assert extract(page, "")["root_kind"] == "body"


def test_junk_classes_and_half_guard():
    assert has_junk_class("x toc-wrapper") and has_junk_class("cookiebar") and not has_junk_class("has-toc ad")
    assert "all" in md("<body><div class='sidebar'>all the words are here</div></body>")
    assert "gone" not in md("<body><div class='sidebar'>gone</div><p>" + "stay " * 9 + "</p></body>")


def test_code_is_kept():
    assert "```python\nx = 1\n\n  y\n```" in md("<pre><code class='language-py'>x = 1\n\n  y</code></pre>")
    assert fence("a ``` b", "").startswith("````")
    assert code_language(parse("<pre class='none'>x</pre>").find("pre")[0]) == ""


def test_tables_links_lists():
    out = md("<table><tr><th>a</th><th colspan=2>b</th></tr><tr><td><ul><li>x</li><li>y</li></ul></td><td>1|2</td></tr></table>")
    assert "| a | b |  |" in out and "| x · y | 1\\|2 |  |" in out
    assert "[go](http://site.example/c)" in md("<p><a href='../c'>go</a></p>")
    assert "- one\n- two" in md("<ul><li>one</li><li>two</li></ul>")


def test_null_and_empty():
    for html in (None, "", "<", "plain"):
        assert extract(html, None)["words"] <= 1


def test_navigation():
    s = step([], None, [], "push", "a")
    s = step(*s, "push", "b")
    s = step(*s, "back", "")
    assert s == ([], "a", ["b"])
    assert step(*s, "forward", "") == (["a"], "b", [])
    assert step(*s, "push", "c") == (["a"], "c", [])
    assert step(*s, "fail", "z") == s


def test_code_frames():
    assert "```\na\nb\n```" in md("<pre><code><div>a</div><div>b</div></code><button>Copy</button></pre>")
    assert "1" not in md("<pre><span class='line-no'>1</span>x</pre>")
    assert md("<table><tr><td class='gutter'>9</td><td><pre>y</pre></td></tr></table>").count("9") == 0
    assert "Terminal" not in md("<figure><figcaption><span class='sr-only'>Terminal</span></figcaption><pre>z</pre></figure>")
    assert "```python" in md("<div class='highlight-python3'><pre>q</pre></div>") and "```\n" in md("<div class='highlight-wrap'><pre>q</pre></div>")


def test_links_and_images():
    assert md("<h2><a href='#x'>Part</a> <a href='#x'>Link to this heading</a></h2>") == "## Part"
    assert md("<p><a href='#c'>Skip to content</a>word <a href='/x'></a><a>name</a></p>") == "word name"
    assert md("<a href='/c'><div><h3>Card</h3><p>about it</p></div></a>") == "### [Card](http://site.example/c)\n\nabout it"
    assert md("<title>A cat</title><p><img alt='cat'>text<img alt='dog'></p>") == "# A cat\n\ntext[image: dog]"


def test_rows_that_span():
    assert md("<table><tr><th>a</th><th>b</th></tr><tr><td rowspan='2'>x</td><td>1</td></tr><tr><td>2</td></tr></table>") == "| a | b |\n| --- | --- |\n| x | 1 |\n|  | 2 |"


def test_openings():
    head, text = ("heading", "# H"), ("paragraph", "some text.")
    assert trimmed([("paragraph", "[a](/a) » [b](/b)"), ("paragraph", "Label"), head, ("rule", "---"), text]) == [head, text]
    assert trimmed([("paragraph", "[lone](/x)"), text]) == [("paragraph", "[lone](/x)"), text]
    assert trimmed([("list", "- one\n- two"), head, text]) == [head, text]
    assert trimmed([head, ("paragraph", "[a](1) [b](2) [c](3) [d](4)"), text]) == [head, text]
    assert trimmed([("paragraph", "Label"), head]) == [("paragraph", "Label"), head] and trimmed([]) == []


def test_types():
    assert converted("# x", "http://a/b.md?q", "text/plain; charset=utf-8") == "# x" and converted("{}", None, "application/ld+json") == "```json\n{}\n```"
    assert converted("x", "http://a/t.txt", None) == "```\nx\n```" and converted("<a/>", "", "application/xml") == "```xml\n<a/>\n```"
    assert converted("x", "", "image/png") is None and converted("<p>x</p>", "", "text/html") == "x" and converted(None, None, None) == ""


def test_odd_pages_end_well():
    for nest in ("<div>", "<b>", "<blockquote>", "<ul><li>", "<table><tr><td>"):
        assert "deep" in md("<body>" + nest * 900 + "deep")
    assert md("<a href='http://[bad'>x</a>") == "[x](http://[bad)"
    assert md("<table><tr><td>a<table><tr><td>b</td><td>c</td></tr></table></td></tr></table>") == "| a b c |\n| --- |"
    assert md("<p title='a>b'>one</p><!-- <p>no</p> --><p>two<!-- never closed") == "one\n\ntwo"
    assert md("<script>if (a < b) '</p>'</script><p>x &lt; y</p>") == "x < y"


def test_many_siblings_take_linear_time():
    import time

    from pagegrain.functions.html import extract

    for part in ('<script>x</script>', '<a href="#x"></a>', '<div class="sidebar">s</div>', '<h2>t<a href="#y">k</a></h2>', '<a href="/z"><div>u</div></a>'):
        began = time.perf_counter()
        extract(f"<html><body><article><p>{'word ' * 200}</p>{part * 32_000}</article></body></html>", "http://a.example/")
        assert time.perf_counter() - began < 8, part


def test_anchors_of_odd_pages(spark):
    from pyspark.sql import functions as F

    from pagegrain.operators import extraction

    html = """<!-- <a href="/c">x</a> --><SCRIPT>'<a href="/s">'</SCRIPT><a href="b?x=1&amp;y=2&#38;z=&#x20AC;&#0;&bogus;">1</a><a href='&lt;&quot;&amp;lt;'>2</a><a href=/plain>3</a><!-- open <a href="/never">"""
    pages = spark.createDataFrame([(1, "http://a.example/", html), (2, None, None)], "page_id int, url string, html string")
    assert [r.href for r in extraction.anchors(pages).orderBy("ord").collect()] == ["b?x=1&y=2&z=€&#0;&bogus;", '<"&lt;', "/plain"]
    assert spark.range(1).select(extraction.unescaped(F.lit("&#97;mp; &#x1F600; &#1114112; a&b"))).first()[0] == "amp; 😀 &#1114112; a&b"
