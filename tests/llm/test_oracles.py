"""Queries that SQL can say, against that SQL: on a small table and on rows of every odd kind."""

import os

import duckdb
import pytest

from raregram.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import EDGES, prose

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    same(QUERIES[name](spark, SF_DIR), con.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("full", [True, False])
def test_odd_rows_are_the_sql(spark, tmp_path, rng, name, full):
    base = prose(rng, 120)
    docs = [*EDGES, (20, base), (21, base[:-9]), (22, base[:300] + " é " + base[200:]), (None, base + " z"), (23, prose(rng, 80)), (24, "a b c")] if full else []
    items = [(1, base[100:300]), (2, "word word word"), (3, None), (4, ""), (5, "a b"), (5, base[50:200]), (None, "same text of a few words"), (6, "é" * 900)] if full else []
    con = duckdb.connect()
    for t, i, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        path = str(tmp_path / f"{t}.parquet")
        spark.createDataFrame(rows, f"{i} long, text string").coalesce(1).write.parquet(path)
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name]))
