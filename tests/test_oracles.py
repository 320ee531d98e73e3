"""Each query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from waymark.plans import catalog, graphs, histories, learning, reports, streams, times  # noqa: F401  they register their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toArrow()
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    rows = found.fetchall()
    assert sorted(names) == sorted(got.column_names)
    columns = sorted(names)
    ours = sorted(map(repr, zip(*(got[c].to_pylist() for c in columns), strict=True)))
    assert ours == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", ["ranker_gbt", "ranker_logistic", "ranker_mlp"])
def test_rankers_choose_one_candidate_for_each_query(spark, name):
    rows = catalog.QUERIES[name](spark, DATA)
    assert rows.count() == rows.select("query_id").distinct().count() > 0
