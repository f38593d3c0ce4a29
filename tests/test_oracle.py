"""Registered queries against DuckDB on the smallest tables."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from sonca.oracle import SQL

SF = "/root/testdata/sf0.001"


def canonical(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = Counter(tuple(map(canonical, r)) for r in got.select(*columns).collect())
    assert a == Counter(tuple(map(canonical, r)) for r in want.fetchall())


def test_entry_is_imported_without_a_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 60)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "True", said.stderr


def test_each_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
