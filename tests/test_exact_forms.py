"""Results that must be those of their SQL in every case: runs in arrays, printed decimals, ties."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrafold.functions import text as tx


def test_contains_run_works_out_the_array_once(spark):
    df = spark.createDataFrame([("a b c",), ("b a",), ("",), (None,)], "s string")
    out = df.select(tx.contains_run(F.split("s", " "), F.array(F.lit("b"), F.lit("c"))).alias("has"))
    assert [x.has for x in out.collect()] == [True, False, False, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def by_sql(name, folder, table):
    with duckdb.connect() as db:
        db.execute("SET threads = 1")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        return sorted(map(str, db.execute(entry.oracle_sql()[name]).fetchall()))


def by_spark(spark, name, folder):
    return sorted(str(tuple(x)) for x in entry.queries()[name](spark, folder).collect())


def test_decimals_are_rounded_from_the_binary_value(spark, tmp_path):
    balances = [1225.0, 1235.0, -1225.0, -4.0, -0.0, 5.0, 15.0, 25.0, 99.95, 9999995.0, -995.0, -985.0, 1e9 + 0.5, None]
    pq.write_table(pa.table({"s_suppkey": pa.array(range(len(balances)), pa.int64()), "s_acctbal": pa.array(balances, pa.float64())}), f"{tmp_path}/supplier.parquet")
    assert by_spark(spark, "format_numbers", str(tmp_path)) == by_sql("format_numbers", tmp_path, "supplier")


def test_lines_that_tie_count_as_stored(spark, tmp_path):
    n = 400
    columns = {"l_orderkey": [i % 7 for i in range(n)], "l_linenumber": [1 + i % 2 for i in range(n)], "l_extendedprice": [float(i % 3) for i in range(n)]}
    columns |= {"l_returnflag": ["NAR"[i * 7 % 11 % 3] for i in range(n)], "l_quantity": [float(i * 13 % 50) for i in range(n)], "l_discount": [i * 17 % 11 / 100 for i in range(n)]}
    rows = pa.table({k: pa.array(v, pa.int32() if k == "l_linenumber" else None) for k, v in columns.items()})
    pq.write_table(rows, f"{tmp_path}/lineitem.parquet", row_group_size=50)
    assert by_spark(spark, "first_non_null_columns", str(tmp_path)) == by_sql("first_non_null_columns", tmp_path, "lineitem")
