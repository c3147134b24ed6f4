"""Pages that share an address: each is an entry of its own, as the SQL says."""

from collections import Counter

import duckdb
import pytest

from pagegrain.operators.memory import refreshed
from pagegrain.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["cache_refreshes", "cache_upserts"])
def test_shared_addresses_like_sql(spark, tmp_path, name):
    pages = spark.createDataFrame([(i, f"https://x.example/{i % 7}", f"<p>{i}</p>") for i in range(30)], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert Counter(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == Counter(found.fetchall())


def test_refreshed_gives_a_row_for_each_cached_one(spark):
    from pyspark.sql import functions as F

    cached = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "url string, content string").withColumn("saved", F.lit("2024-01-01").cast("timestamp"))
    fetched = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "z")], "url string, content string")
    got = refreshed(cached, fetched, F.lit("2024-01-01 00:01:00").cast("timestamp"))
    assert sorted((r.url, r.newer) for r in got.collect()) == [("a", False), ("a", True), ("b", True)]


def test_upserts_by_another_key(spark):
    from pagegrain.sources import sinks

    old = spark.createDataFrame([(1, "a", "old"), (2, "a", "old"), (3, None, "old")], "page_id bigint, url string, content string").selectExpr("*", "timestamp'2024-01-01' as saved")
    new = old.where("page_id = 2").selectExpr("page_id", "url", "'new' as content", "timestamp'2024-01-02' as saved")
    kept = sinks.deleted(sinks.upserted(old, new, "page_id"), old.where("page_id = 3"), "page_id")
    assert sorted((r.page_id, r.url, r.content) for r in kept.collect()) == [(1, "a", "old"), (2, "a", "new")]
