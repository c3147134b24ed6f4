"""Sources and sinks on small files, and the web source against a local server."""

import datetime
import http.server
import threading

import pytest

from pagegrain.sources import files, sinks, web


def put(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_histories(spark, tmp_path):
    path = put(tmp_path / "h.jsonl", '{"url": "a", "title": "A", "at": "2024-01-01T00:00:00Z"}\n{broken\n{"url": ""}\n{"title": "x"}\n\n{"url": "b"}\n')
    assert [(r.url, r.title) for r in files.history(spark, path).orderBy("pos").collect()] == [("a", "A"), ("b", None)]
    out = str(tmp_path / "out")
    sinks.append_history(files.history(spark, path), out)
    sinks.append_history(files.history(spark, path), out)
    assert files.history(spark, out).count() == 4
    assert [(r.url, r.pos) for r in files.bookmarks(spark, put(tmp_path / "b.json", '[\n{"url": "x", "title": "X"},\n{"url": "y"}]')).collect()] == [("x", 0), ("y", 1)]
    assert files.bookmarks(spark, put(tmp_path / "c.json", "[{")).count() == 0


def test_logs_maps_settings(spark, tmp_path):
    log = put(tmp_path / "log", "# note\nBenchmarkA-8   100   12.5 ns/op   3 B/op   1 allocs/op\nBenchmarkB/x-8 1 7 ns/op\nPASS\n")
    assert sorted(map(tuple, files.benchmark_log(spark, log).collect())) == [("BenchmarkA", 12.5, 3.0, 1), ("BenchmarkB/x", 7.0, None, None)]
    assert [r.url for r in files.sitemap(spark, put(tmp_path / "s.xml", "<loc>http://a/b</loc><loc>http://a/c.xml</loc><loc> http://a/b </loc>")).collect()] == ["http://a/b"]
    assert [tuple(r) for r in files.table_file(spark, put(tmp_path / "t.tsv", "go\t3\nx\n"), "name string, n int", "\t").collect()][0] == ("go", 3)
    got = {r.name: r.value for r in files.settings(spark, 'width = 90\ncache = "no"\nnew = 1', {"width": 80, "cache": True}).collect()}
    assert got == {"width": "90", "cache": "true"} and files.settings(spark, "= =", {"a": 1}).head().value == "1"
    assert files.cache_files(spark, str(tmp_path)).where("path like '%log'").head().size > 0


def test_requests(spark):
    rows = [(1, 0, '{"id": "1", "method": "read", "params": {"a": 1}}'), (1, 1, "bad"), (1, 2, '{"id": "2", "method": "x"}'), (1, 3, "bad"), (1, 4, "bad"), (1, 5, '{"id": "3"}'), (2, 0, ""), (2, 1, None)]
    got = files.requests(spark.createDataFrame(rows, "session int, seq int, value string")).orderBy("seq").collect()
    assert [(r.seq, r.method, r.bad) for r in got] == [(0, "read", False), (1, None, True), (2, "x", False), (3, None, True), (4, None, True)]
    texts = spark.createDataFrame([('{"tag_name": "v1", "assets": [{"name": "n"}]}',), ("{",)], "value string")
    assert [r.tag for r in files.release_info(texts).collect()] == ["v1", None]


@pytest.mark.parametrize(("raw", "said", "want"), [
    ("é".encode(), None, "é"), ("é".encode()[:-1], None, "�"), (b"\xe9t\xe9 ", None, "été "), (b"\xef\xbb\xbfx", None, "x"), ("é".encode("utf-16"), None, "é"),
    (b"\xe9", "text/html; charset=ISO-8859-1", "é"), (b'<meta charset="cp1251">\xe9', None, '<meta charset="cp1251">й'), (b"x", "charset=nonsense", "x"), (b"", None, ""), (None, None, None),
])
def test_decode(raw, said, want):
    assert files.decode(raw, said) == want


def test_local_pages(spark, tmp_path):
    put(tmp_path / "p.html", "<p>é</p>".encode("cp1252"))
    assert files.decoded(files.local_pages(spark, str(tmp_path))).head().html == "<p>é</p>"


def test_cache(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    ddl = "url string, content string, saved timestamp"
    cache = spark.createDataFrame([("a", "old", t(1)), ("b", "old", t(9))], ddl)
    new = spark.createDataFrame([("a", "new", t(1)), ("b", "new", t(2)), ("c", "new", None), (None, "x", t(3))], ddl)
    got = sinks.upserted(cache, new)
    assert sorted((r.url, r.content) for r in got.collect()) == [("a", "new"), ("b", "old"), ("c", "new")]
    assert [r.url for r in sinks.deleted(cache, new.limit(1)).collect()] == ["b"]
    assert [r.url for r in sinks.pruned(cache, t(10), 5).collect()] == ["b"]


def test_replies_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "ok", None), ("2", None, "no")], "id string, result string, error string")
    got = {r.id: r.reply for r in sinks.replies(rows).collect()}
    assert got["1"] == '{"jsonrpc":"2.0","id":"1","result":{"content":[{"type":"text","text":"ok"}],"isError":false}}' and '"message":"no"' in got["2"]
    wide = spark.createDataFrame([(1, "x" * 300, ["a"])], "n int, t string, l array<string>")
    sinks.write_report(wide, str(tmp_path / "r"))
    row = spark.read.option("header", "true").option("quote", '"').option("escape", "\\").csv(str(tmp_path / "r/csv")).head()
    assert len(row.t) == 200 and row.l == '["a"]' and len(spark.read.json(str(tmp_path / "r/json")).head().t) == 300


def test_web(spark):
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "gone" in self.path else 200)
            self.send_header("Content-Type", "image/png" if "png" in self.path else "text/html")
            self.end_headers()
            self.wfile.write(b"<title>x</title>")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    urls = [f"{at}/a", f"{at}/gone", f"{at}/x.png", "http://127.0.0.1:9/", "nonsense"]
    try:
        for rows in (web.web_pages(spark, urls, 2).collect(), web.fetched(spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string")).collect()):
            got = {r.url: r for r in rows}
            assert len(rows) == 5 and bytes(got[urls[0]].content) == b"<title>x</title>" and got[urls[0]].error is None
            assert got[urls[1]].status == 404 and got[urls[2]].error == "unsupported type image/png" and "refused" in got[urls[3]].error and got[urls[4]].error
    finally:
        server.shutdown()


def test_bookmarks_and_odd_answers(spark, tmp_path):
    from pagegrain.sources import files, sinks, web

    marks = spark.createDataFrame([("http://a", "A", 2), ("http://b", "B", 1), ("http://c", None, 3)], "url string, title string, pos int").selectExpr("url", "title", "timestamp'2024-01-01 00:00:00' at", "pos")
    sinks.write_bookmarks(marks, str(tmp_path / "marks"))
    assert [r.url for r in files.bookmarks(spark, str(tmp_path / "marks")).orderBy("pos").collect()] == ["http://b", "http://a", "http://c"]
    assert [files.decode(b"abc", f"text/html; charset={x}") for x in ("undefined", "idna", "hex", "nosuch")] == ["abc"] * 4
    assert web.fetch("http://a b/")[1:5] == (None, None, None, None)
