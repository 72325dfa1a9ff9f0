"""Corpus operators against their SQL twins on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lingloom.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


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
    rows = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == Counter(tuple(r[k] for k in at) for r in want.fetchall()) and rows
