"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: f for k, f in entry.queries().items() if not k.startswith("op") and k != "pipeline"}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = OWN[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert df.columns
        return
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, out.fetchall())
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
