"""Every registered query of the subpackage, against its SQL where there is one."""

import os
from collections import Counter

import duckdb
import pytest

from quire.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def rows(found):
    return Counter(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name in queries.ORACLE:
        want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
        assert rows(got) == rows(want)
    assert got


def test_all_sql_has_a_query():
    assert set(queries.ORACLE) <= set(queries.QUERIES) and {f"p{n}_found" for n in (1, 3, 4, 5, 6, 9)} <= set(queries.QUERIES)
