"""Every registered query with oracle SQL gives the rows that the other engine gives, on the smallest tables."""

import math
from pathlib import Path

import pytest

from loreweave.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in SF.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_agree(spark, duck, name):
    df = registry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    other = duck.sql(registry.oracle_sql()[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in other.fetchall())


def test_queries_without_an_oracle_run(spark):
    for name in sorted(registry.queries().keys() - registry.oracle_sql().keys()):
        assert registry.queries()[name](spark, str(SF)).count() >= 0, name
