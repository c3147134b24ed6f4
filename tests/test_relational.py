"""Each relational query against its DuckDB twin at sf0.001."""

import duckdb
import pytest

from pagegrain.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, name):
    found = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert _rows(got.select(*columns).collect()) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
