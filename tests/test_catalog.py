"""Every registered query with a DuckDB text gives the same rows on the small tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import sparklines.plans.catalog_jobs  # noqa: F401 (registers its queries)
from sparklines.plans.catalog import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return str(v)
    return round(float(v), 9) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


def rows(cols, got):
    order = sorted(cols)
    return sorted(([plain(r[cols.index(c)]) for c in order] for r in got), key=repr), order


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    want = duck.sql(SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
