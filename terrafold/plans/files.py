"""Scans and sinks: what is written and read back equals the table it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators.quality import file_manifest, verify_manifest
from terrafold.operators.tables import scratch_path
from terrafold.operators.tables import table as t
from terrafold.registry import register
from terrafold.sources import readers, sinks


@register("scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'N'")
def scan_pruned(spark, d):
    return t(spark, d, "lineitem").where((F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1997-01-01'")) & (F.col("l_returnflag") == "N")).select("l_orderkey", "l_quantity")


@register("scan_box", "SELECT vec_id FROM embeddings WHERE 1000 * embedding[1]::DOUBLE + 5 >= -50 AND 1000 * embedding[1]::DOUBLE - 5 <= 60 AND 1000 * embedding[2]::DOUBLE + 5 >= -40 AND 1000 * embedding[2]::DOUBLE - 5 <= 90")
def scan_box(spark, d):
    """A window on a nested box, pushed down to the files."""
    x, y = (F.col("embedding")[i].cast("double") * 1000 for i in (0, 1))
    box = F.struct((x - 5).alias("xmin"), (x + 5).alias("xmax"), (y - 5).alias("ymin"), (y + 5).alias("ymax"))
    path = scratch_path(spark, "boxes")
    sinks.write_parquet(t(spark, d, "embeddings").select("vec_id", box.alias("bbox")), path)
    return readers.scan(spark, path, ["vec_id"], (-50.0, 60.0, -40.0, 90.0))


@register("csv_round_trip", "SELECT printf('%011d', c_custkey) AS geoid, printf('%.6f', c_acctbal / 7) AS value, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer")
def csv_round_trip(spark, d):
    """Fixed decimals out; ids as text and empty as null back."""
    path = scratch_path(spark, "csv")
    out = t(spark, d, "customer").select(F.format_string("%011d", "c_custkey").alias("geoid"), (F.col("c_acctbal") / 7).alias("value"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    sinks.write_csv_fixed(out, path, order=["geoid"])
    return readers.read_csv(spark, path, "geoid string, value string, segment string")


@register("csv_gzip_lineage", "SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderstatus AS status, TRUE AS has_file FROM orders WHERE o_orderstatus = 'F'")
def csv_gzip_lineage(spark, d):
    """Many gzip CSVs as strings, filtered as read, with the file's name."""
    path = scratch_path(spark, "gz")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status"))
    o.repartition(3).write.option("header", True).option("compression", "gzip").csv(path)
    got = readers.read_csv_lineage(spark, [path], "event_id string, status string", F.col("status") == "F")
    return got.select("event_id", "status", F.col("source_file").endswith(".csv.gz").alias("has_file"))


@register("geojson_scan", "SELECT s_suppkey AS objectid, s_name AS road, round(s_acctbal / 100, 4) AS _lon, (s_nationkey)::DOUBLE AS _lat FROM supplier")
def geojson_scan(spark, d):
    """A feature collection written by one aggregate over a list of a known small size, read back as a table."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("s_suppkey").alias("objectid"), F.col("s_name").alias("road")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col("s_acctbal") / 100, 4), F.col("s_nationkey").cast("double")).alias("coordinates")).alias("geometry"))
    doc = t(spark, d, "supplier").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(f).alias("features"))).alias("value"))
    path = scratch_path(spark, "geojson")
    doc.write.text(path)
    return readers.read_geojson(spark, path, "objectid bigint, road string")


@register("json_bag", "SELECT COUNT(*) AS n, MAX(o_orderkey) AS top FROM orders")
def json_bag(spark, d):
    """Measures as one JSON document, read back."""
    path = scratch_path(spark, "json")
    t(spark, d, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top")).select(F.to_json(F.struct("n", "top")).alias("value")).write.text(path)
    return spark.read.schema("n bigint, top bigint").json(path)


@register("partitioned_parquet", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def partitioned_parquet(spark, d):
    """Written by region, read with the partitions pruned."""
    path = scratch_path(spark, "by_status")
    sinks.write_parquet(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


@register("newest_versions", "SELECT 'details' AS tbl, 2000 + k % 3 AS year, 'details_d' || (2000 + k % 3) || '_c' || (20200100 + MAX(k)) || '.csv.gz' AS file FROM (SELECT n_nationkey AS k FROM nation) GROUP BY k % 3")
def newest_versions(spark, d):
    k = F.col("n_nationkey")
    listing = t(spark, d, "nation").select(F.format_string("details_d%d_c%d.csv.gz", 2000 + k % 3, F.lit(20200100) + k).alias("file"))
    return readers.newest_versions(listing)


def numbers_page(offset, limit):
    """A stand-in for a paged service: 2,345 records."""
    if offset is None:
        return 2345
    return [(i, f"record {i}") for i in range(offset, min(2345, offset + limit))]


@register("paged_source", "SELECT i AS id, 'record ' || i AS name FROM range(2345) r(i)")
def paged_source(spark, d):
    spark.dataSource.register(readers.PagedSource)
    return spark.read.format("paged").option("fetch", "terrafold.plans.files:numbers_page").option("schema", "id bigint, name string").load()


@register("tolerant_scan", "SELECT n_nationkey AS key, n_name AS name, CAST(NULL AS VARCHAR) AS level_rules FROM nation")
def tolerant_scan(spark, d):
    """Columns that the file lacks are null."""
    path = scratch_path(spark, "tolerant")
    t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).write.parquet(path)
    return readers.scan_tolerant(spark, path, "key int, name string, level_rules string")


@register("row_positions", "SELECT COUNT(*) AS n, COUNT(*) AS keys FROM nation")
def row_positions(spark, d):
    """File and row number as a key."""
    p = readers.with_position(t(spark, d, "nation"))
    return p.agg(F.count("*").alias("n"), F.count_distinct("file", "row").alias("keys"))


@register("manifest_check", "SELECT 'gone.csv' AS name, 'missing' AS problem")
def manifest_check(spark, d):
    """Sizes and digests of files against a manifest that lists one more."""
    path = scratch_path(spark, "manifest")
    t(spark, d, "region").coalesce(1).write.csv(path)
    found = file_manifest(spark, path).where("name like 'part-%'")
    more = spark.createDataFrame([("gone.csv", 1, "0")], "name string, bytes long, sha256 string")
    return verify_manifest(found, found.union(more))


@register("export_tables", "SELECT r_regionkey AS x_r_regionkey FROM region")
def export_tables(spark, d):
    root = scratch_path(spark, "export")
    path = sinks.export({"region": t(spark, d, "region")}, root, deny=["r_name"], prefix="x_")[0]
    return spark.read.parquet(path)


@register("shared_blocks", "SELECT s_nationkey AS block, COUNT(*) AS homes, round(SUM(s_acctbal), 4) AS people FROM supplier WHERE s_nationkey BETWEEN 3 AND 17 GROUP BY 1")
def shared_blocks(spark, d):
    """A service's grouped sums within an envelope, as a filter and an aggregate."""
    s = t(spark, d, "supplier").where(F.col("s_nationkey").between(3, 17))
    return s.groupBy(F.col("s_nationkey").alias("block")).agg(F.count("*").alias("homes"), F.round(F.sum("s_acctbal"), 4).alias("people"))
