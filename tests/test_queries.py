"""Every query of the catalog against its SQL, and the driver's contract."""

import os
import sys

import duckdb
import pytest

import __spark_entry__
from raregram.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_does_not_import_the_training_data_operators():
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import importlib, pathlib, sys
for f in sorted(pathlib.Path("raregram").rglob("*.py")):
    if "llm" not in f.parts:
        importlib.import_module(".".join(f.with_suffix("").parts).removesuffix(".__init__"))
print(any(n.startswith("raregram.llm") for n in sys.modules))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True)
    assert said.stdout.strip() == "False"
