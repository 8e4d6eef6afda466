"""Every query with an oracle against DuckDB on the smallest tables, and the others for rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from pmx import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Empty on the smallest tables.
MAY_BE_EMPTY = {"t8_anomalies", "keyword_jaccard", "volume_spikes", "bt_cal_surface", "size_by_category"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(cols, got):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_oracle(name, spark, con, sf):
    df = registry.queries()[name](spark, sf)
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    a, b = rows(df.columns, df.collect()), rows(cols, want.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert a == b
    assert a or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0 or name == "t4_evolution"  # no day has enough strikes there


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())
