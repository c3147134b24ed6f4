"""The postings index against a plain search, and what of it a query reads."""

import random
import re

import pytest

from pagegrain.operators import postings


def _entries():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", " ABC", "\n"]), " ".join(word() for _ in range(2))) for i in range(150)]
    return [*rows, (200, None, "abc"), (201, "", None), (202, "ABCabc abcabc", "Ab"), (203, "x" * 200, "x")]


def _plain(rows, query, best=24):
    terms = postings.terms_of(query)
    out = []
    for key, body, title in rows:
        b, t = (body or "").lower(), (title or "").lower()
        if terms and all(x in b or x in t for x in terms):
            out.append((key, sum(8 * (x in t) + min(12, b.count(x)) + 2 * b.startswith(x) for x in terms)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:best]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(_entries(), "id bigint, body string, title string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, entries):
    return postings.build(spark, entries, "id", "body", "title")


@pytest.mark.parametrize("query", ["abc", "ab cd", "AB éa, cd", "zz", "ab zz", "", "a", "abc abc", "bé"])
def test_search_like_a_plain_one(spark, index, query):
    assert [tuple(r) for r in postings.search(spark, index, query).collect()] == _plain(_entries(), query)


def test_scope_and_many_entries(spark, entries, index, monkeypatch):
    scope = entries.where("id % 2 = 0").selectExpr("id entry")
    assert [tuple(r) for r in postings.search(spark, index, "ab", scope).collect()] == _plain([r for r in _entries() if r[0] % 2 == 0], "ab")
    monkeypatch.setattr(postings, "FEW_ENTRIES", 1)
    monkeypatch.setattr(postings, "FEW_WORDS", 0)
    assert [tuple(r) for r in postings.search(spark, index, "ab cd").collect()] == _plain(_entries(), "ab cd")


def test_only_the_terms_folders_are_read(spark, index):
    def folders(df):
        """By scan of the plan: the buckets that its partition filter lets through."""
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        return [set(re.findall(r"\d+", re.sub(r"#\d+", "", f))) for f in re.findall(r"PartitionFilters: \[isnotnull\(bucket#\d+\), (.*?)\], PushedFilters", plan)]

    words = postings.words_of(spark, index, ["abcabc"])
    assert [len(f) for f in folders(words)] == [1]
    wanted = {str(r[0]) for r in words.select(postings._bucket(words.word, postings.BUCKETS)).distinct().collect()}
    there = {str(r[0]) for r in index.postings(spark).select("bucket").distinct().collect()}
    scans = folders(postings.matched(spark, index, ["abcabc"]))
    assert wanted in scans and len(wanted) < len(there) and all(len(f) == 1 or f == wanted for f in scans)


def test_snippets_and_empty_tables(spark, entries, index):
    long = spark.createDataFrame([(1, "y" * 300 + " needle " + "z" * 300, "t"), (2, "needle first", "a")], "id bigint, body string, title string")
    rows = postings.hits(spark, postings.build(spark, long, "id", "body", "title"), long, "id", "body", "title", "needle").collect()
    assert [(r.id, r.score) for r in rows] == [(2, 3), (1, 1)] and rows[0].snippet == "needle first"
    assert rows[1].snippet == "…" + ("y" * 300 + " needle " + "z" * 300)[228:448] + "…"
    none = postings.build(spark, entries.limit(0), "id", "body", "title")
    assert postings.search(spark, none, "abc").count() == 0
