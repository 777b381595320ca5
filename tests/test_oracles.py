"""Every registered query against its SQL, on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest
from conftest import ROOT

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.select(*columns).toArrow().to_pylist()]
    if name not in entry.oracle_sql():
        assert found
        return
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    expected = [tuple(row[i] for i in places) for row in relation.fetchall()]
    assert ordered(found) == ordered(expected)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "model"
