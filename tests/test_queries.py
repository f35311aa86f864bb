"""Every registered cohort query gives the rows of its DuckDB SQL at the smallest scale; the others give rows."""

import math
import os

import pytest

import __spark_entry__
from tessera.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float) or hasattr(x, "as_integer_ratio"):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x + 0.0:.6g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    columns, rows = sorted(found.columns), found.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    expected = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    theirs = [dict(zip(expected.columns, r)) for r in expected.fetchall()]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[c]) for c in columns] for r in theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
