"""The operators' queries against their SQL."""

import duckdb
import pytest

from terrafold.llm import queries
from tests.test_queries import SF, TABLES, rows


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in out.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, out.fetchall())
