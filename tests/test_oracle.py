"""Every registered query against its SQL twin on the smallest tables."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lingloom.plans.registry import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
