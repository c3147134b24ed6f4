"""Sections, tables, releases, notes, keys, addresses and code guesses on fixtures; guesses against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagegrain.functions import code
from pagegrain.functions import text as T
from pagegrain.operators import markdown as M

DOC = """---
a: b
---
# The *Title*

- [One](#one)
- [Two](#two)

Lead `text` here.



- [lone](#x)

## One `a`

body
```
## not a heading
```

## Two

| a | b |
| - | - |
| `1` | 2 |
| 3 | 4 |

| no table |
"""


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id bigint, markdown string")


def test_sections(spark):
    docs = frame(spark, DOC, None, "", "no heading")
    assert [tuple(r) for r in M.sections(docs).orderBy("ord").collect()] == [
        (0, 1, "one-a", "One a", "body\n```\n## not a heading\n```"),
        (0, 2, "two", "Two", "| a | b |\n| - | - |\n| `1` | 2 |\n| 3 | 4 |\n\n| no table |"),
    ]
    got = {r.page_id: tuple(r)[1:] for r in M.introductions(docs).collect()}
    assert got == {0: ("The Title", "Lead text here.", "Lead `text` here.\n\n- [lone](#x)"), 1: ("", "", ""), 2: ("", "", ""), 3: ("", "no heading", "no heading")}


def test_tables(spark):
    rows = [(r.tbl, r.row, r.heading, r.cells) for r in M.tables(frame(spark, DOC, None, "x\n|h|\n--|--\n|v|\nend\n|a|\n|-|")).orderBy("page_id", "tbl", "row").collect()]
    assert rows == [(0, 0, "Two", ["a", "b"]), (0, 1, "Two", ["`1`", "2"]), (0, 2, "Two", ["3", "4"]), (0, 0, None, ["h"]), (0, 1, None, ["v"]), (1, 0, None, ["a"])]


def test_releases_and_notes(spark):
    log = "# Changes\n\n## [1.2.0](http://c.example) (2024-01-02)\n\n### Features\n\n* **ui:** add [x](http://y) ([abcdef1](http://z))\n\n## v1.1.0\n\nold `b`\n## not one here\n"
    got = [tuple(r)[1:] for r in M.releases(frame(spark, log)).orderBy("ord").collect()]
    assert got[0] == (1, "1.2.0", "http://c.example", "2024-01-02", "### Features\n\n* **ui:** add [x](http://y) ([abcdef1](http://z))", "Features ui: add x (abcdef1)", True)
    assert got[1] == (2, "1.1.0", None, None, "old `b`\n## not one here", "old b not one here", False)
    notes = [(r.kind, r.note) for r in M.release_notes(frame(spark, log)).orderBy("ord").collect()]
    assert notes[1:4] == [("title", "2024-01-02"), ("head", "Features"), ("item", "ui: add x")]


def test_keys_and_links(spark):
    src = '{actNextPart, "Move", "next"} {actQuit, "App", "quit"} actNextPart: {"n", "]"}'
    got = [tuple(r)[1:] for r in M.key_bindings(frame(spark, src), "page_id", "markdown").orderBy("ord").collect()]
    assert got == [(0, "next_part", "Move", "next", ["n", "]"]), (1, "quit", "App", "quit", [])]
    docs = spark.createDataFrame([(1, '<a href="#one">x</a><a href="#two">y</a><a href="../READ.md#z">r</a>'), (2, None)], "page_id bigint, html string")
    slugs = spark.createDataFrame([(1, "one")], "page_id bigint, slug string")
    assert {r.page_id: r.html for r in M.rewritten_links(docs, slugs, "/docs", "/repo").collect()} == {1: '<a href="/docs/one">x</a><a href="#two">y</a><a href="/repo/READ.md#z">r</a>', 2: None}


def test_small_functions(spark):
    row = spark.range(1).select(
        T.inline_html(F.lit("a < `b`")).alias("h"), T.md_escape(F.lit(" a\n[b] `c` \\ ")).alias("e"), T.plain_body(F.lit("# H\n- a ![i](u) **b**\n```\ncode\n```\n<i>c</i>")).alias("b"),
        M.without_lead(F.lit("The *lead*.\n\nrest"), F.lit("The lead.")).alias("w"), M.without_lead(F.lit("other\n\nrest"), F.lit("x")).alias("o"),
    ).head()
    assert tuple(row) == ("a &lt; <code>b</code>", "a \\[b\\] \\`c\\` \\\\", "H a b c", "rest", "other\n\nrest")


@pytest.mark.parametrize(("typed", "want", "search"), [
    (" https://a.b ", "https://a.b", False), ("", "", False), ("a.example/x?y", "https://a.example/x?y", False), ("localhost:8080", "http://localhost:8080", False),
    ("192.168.1.7", "http://192.168.1.7", False), ("172.32.0.1", "https://172.32.0.1", False), ("x.test", "http://x.test", False), ("two words", "https://html.duckduckgo.com/html/?q=two+words", True),
    ("nodot", "https://html.duckduckgo.com/html/?q=nodot", True), (".start", "https://html.duckduckgo.com/html/?q=.start", True), ("a.example:80x", "https://html.duckduckgo.com/html/?q=a.example%3A80x", True),
    ("/etc/x", "file:///etc/x", False), ("~/x", "file:///home/u/x", False), (None, None, None),
])
def test_typed_addresses(spark, typed, want, search):
    r = spark.createDataFrame([(typed,)], "s string").select(T.resolved_input(F.col("s"), home="/home/u").alias("r")).head().r
    assert (r and (r.target, r.is_search)) == (want and (want, search) if typed else r and ("", False))


def test_code_guesses(spark):
    rows = list(enumerate(code.SAMPLES))
    got = {r.i: r.lang for r in spark.createDataFrame(rows, "i int, c string").select("i", code.guessed_language(F.col("c")).alias("lang")).collect()}
    assert [got[i] for i in range(10)] == ["go", "python", "javascript", "typescript", "sql", "rust", "java", "csharp", "bash", "json"]
    q = "values " + ", ".join("({}, '{}')".format(i, c.replace("'", "''")) for i, c in rows)
    want = dict(duckdb.sql(code.duckdb_guess(f"select * from ({q}) as t(sample, code)")).fetchall())
    assert got == want


def test_fences_and_spans(spark):
    from pyspark.sql import functions as F

    from pagegrain.operators import search

    text = "# T\n```a`b\n```go\n~~~\n## no\n````\n## yes\n~~~~\n```\n~~~\n## code\n~~~~~  \n## two\n```\nend"
    docs = spark.createDataFrame([(1, text), (2, None)], "page_id int, markdown string")
    got = {r.pos: r.code for r in M.fenced_lines(docs).collect()}
    assert [p for p, code in sorted(got.items()) if not code] == [0, 1, 6, 12]
    assert [r.heading for r in M.sections(docs).orderBy("ord").collect()] == ["yes", "two"]
    lines = spark.createDataFrame([(1, 0, "aXa a.a aaaa É"), (1, 1, "A.A"), (1, 2, None)], "doc_id int, line int, text string")
    found = lambda q: sorted((r.line, r.start, r.stop) for r in search.matches(lines, F.lit(q)).collect())
    assert found("aa") == [(0, 8, 10), (0, 10, 12)] and found("a.a") == [(0, 4, 7), (1, 0, 3)] and found("A.A") == [(1, 0, 3)]
    assert found("é") == [(0, 13, 14)] and found("") == [] and found("\\E") == []


def test_rows_of_one_key_stay_apart(spark):
    docs = spark.createDataFrame([(1, "## A\n\n\none"), (1, "x\n## B\ntwo\n\n\n[l](u)\n[l](u)")], "page_id int, markdown string")
    assert sorted(r.markdown for r in M.tidied(docs).collect()) == ["## A\n\none", "x\n## B\ntwo\n\n[l](u)\n[l](u)"]
    assert sorted((r.ord, r.heading, r.body) for r in M.sections(docs).collect()) == [(1, "A", "one"), (1, "B", "two\n\n\n[l](u)\n[l](u)")]
    assert sorted(r.markdown for r in M.without_repeated_links(docs).collect()) == ["## A\n\n\none", "x\n## B\ntwo\n\n\n[l](u)"]
    two = spark.createDataFrame([(1, "|a|\n|-|\n|b|"), (1, "|c|\n|-|\n|d|")], "page_id int, markdown string")
    assert sorted((r.tbl, r.row, r.cells[0]) for r in M.tables(two).collect()) == [(0, 0, "a"), (0, 0, "c"), (0, 1, "b"), (0, 1, "d")]
    from pagegrain.operators import search

    lines = spark.createDataFrame([(1, 0, "the the"), (1, 0, "a the")], "doc_id int, line int, text string")
    assert sorted((r.start, r.stop) for r in search.matches(lines, F.lit("the")).collect()) == [(0, 3), (2, 5), (4, 7)]


def test_many_fences_and_spans_take_linear_time(spark):
    import time

    from pagegrain.operators import search

    docs = spark.createDataFrame([(1, "```\n" * 64_000)], "page_id int, markdown string").cache()
    M.fenced_lines(docs).count()
    began = time.perf_counter()
    assert M.fenced_lines(docs).where("code").count() == 64_000
    assert time.perf_counter() - began < 6
    lines = spark.createDataFrame([(1, 0, "ab" * 30_000)], "doc_id int, line int, text string")
    got = search.matches(lines, F.lit("a")).agg(F.count("*"), F.max("start"), F.sum("start")).first()
    assert tuple(got) == (30_000, 59_998, sum(range(0, 60_000, 2)))
