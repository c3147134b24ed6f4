"""The cache store: what a lookup reads, what a change rewrites; history rewriting and feeds."""

import re

import pytest
from pyspark.sql import functions as F

from pagegrain.sources import sinks
from pagegrain.sources.store import CacheStore

PAGES = "url string, content string, saved timestamp"


def _pages(spark, rows):
    return spark.createDataFrame(rows, "url string, content string, day string").select("url", "content", F.col("day").cast("timestamp").alias("saved"))


def _files(path):
    return {f.relative_to(path).as_posix() for f in path.rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    held = CacheStore(spark, str(tmp_path / "cache"))
    held.put(_pages(spark, [(f"https://a.example/{i}", f"page {i}", "2024-01-01" if i % 2 else "2024-02-01") for i in range(60)] + [(None, "x", "2024-01-01"), ("https://a.example/0", "older", "2023-01-01"), ("https://e.example/", None, None)]))
    return held


def test_lookups_read_their_folders_alone(spark, store):
    asked = spark.createDataFrame([("https://a.example/7",), ("https://a.example/0",), ("https://a.example/0",), ("https://no.example/",), (None,)], "url string")
    found = store.get(asked)
    assert sorted((r.url, r.content) for r in found.collect()) == [("https://a.example/0", "page 0"), ("https://a.example/7", "page 7")]
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    filters = re.findall(r"PartitionFilters: \[prefix#\d+ IN \((.*?)\)", plan)
    assert filters and all(len(f.split(",")) == 3 for f in filters), plan
    assert len(store.rows().select("prefix").distinct().collect()) > 20
    assert store.get(spark.createDataFrame([("https://e.example/",)], "url string")).collect()[:] == []  # an entry without a time isn't valid
    assert CacheStore(spark, store.path + "-none").get(asked).count() == 0


def test_other_versions_and_other_addresses_are_no_hits(spark, store):
    asked = spark.createDataFrame([("https://a.example/1",)], "url string")
    assert store.get(asked).count() == 1
    assert CacheStore(spark, store.path, version="3").get(asked).count() == 0
    # An entry under the right key, made for another address: the header tells.
    row = store.rows().where("url = 'https://a.example/1'")
    wrong = row.withColumn("header", F.replace("header", F.lit("/1"), F.lit("/other")))
    store._replace(wrong, [row.first().prefix])
    assert store.get(asked).count() == 0


def test_changes_rewrite_the_folders_they_touch(spark, store, tmp_path):
    before = _files(tmp_path / "cache")
    touched = store.put(_pages(spark, [("https://a.example/3", "new", "2024-03-01")]))
    after = _files(tmp_path / "cache")
    assert {f.split("/")[0] for f in before ^ after} == {f"prefix={touched[0]}"} and len(touched) == 1
    assert store.get(spark.createDataFrame([("https://a.example/3",)], "url string")).first().content == "new"
    one = spark.createDataFrame([("https://a.example/3",), ("https://absent.example/",)], "url string")
    store.delete(one)
    assert store.get(one).count() == 0 and store.rows().count() == 60
    rest = _files(tmp_path / "cache")
    store.delete(one)
    assert len(_files(tmp_path / "cache")) == len(rest)


def test_pruning_is_seldom_and_stats_add_up(spark, store):
    assert store.maybe_prune("2024-02-10 00:00:00") and store.rows().count() == 31  # those of January but without a time
    store.put(_pages(spark, [("https://b.example/", "old", "2023-01-01")]))
    assert not store.maybe_prune("2024-02-10 00:59:00") and store.rows().count() == 32
    assert store.maybe_prune("2024-02-10 01:00:01") and store.rows().count() == 31
    row = store.stats().first()
    assert row.entries == 31 and row.size == store.rows().agg(F.sum(F.octet_length("header") + 1 + F.octet_length("content"))).first()[0]
    store.clear()
    assert store.stats().first().entries == 0 and store.maybe_prune("2024-02-10 01:00:02")


def test_history_is_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "history")
    visits = spark.createDataFrame([("u1", "a", "2024-01-01"), ("u2", "b", "2024-01-02"), ("", "c", "2024-01-03")], "url string, title string, at string")
    sinks.append_history(visits, path)
    sinks.rewrite_history(spark.read.json(path).where("url <> 'u1'"), path)
    assert [r.url for r in spark.read.json(path).collect()] == ["u2"] and not (tmp_path / "history.new").exists()


def test_a_feed_is_one_file_in_order(spark, tmp_path):
    releases = spark.createDataFrame([(2, "1.1.0", "2024-01-02", "b < c"), (1, "1.2.0", None, None)], "ord bigint, version string, released string, plain string")
    sinks.write_feed(sinks.feed_items(releases, "tool", "https://x", "ord"), str(tmp_path / "feed"), "tool releases")
    text = "".join(f.read_text() for f in sorted((tmp_path / "feed").glob("part-*")))
    assert text.startswith("<?xml") and text.rstrip().endswith("</channel></rss>")
    assert re.findall(r"<title>(.*?)</title>", text) == ["tool releases", "tool 1.2.0", "tool 1.1.0"]
    assert "<pubDate>Thu, 01 Jan 1970 00:00:00 GMT</pubDate>" in text and "b &lt; c" in text
