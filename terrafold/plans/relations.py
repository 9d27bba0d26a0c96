"""Projections, filters, joins, aggregates, window-like operators, sorts, sets, dates and arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafold.functions import scoring as sc
from terrafold.functions.text import contains_run, number_norm, pad_id
from terrafold.operators import quality
from terrafold.operators import relational as rel
from terrafold.operators.tables import table as t
from terrafold.registry import register

W = Window


def big(c, name):
    return c.cast("bigint").alias(name)


# --- projections ---------------------------------------------------------------------------------------------------


@register(
    "proj_harmonise",
    """SELECT 'supplier' AS src, CAST(s_suppkey AS VARCHAR) AS src_id, 'supplier:' || s_suppkey AS full_id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'customer:' || c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def proj_harmonise(spark, d):
    """Two inventories to one schema, with lineage and a concatenated id."""
    one = lambda df, src, k, seg: df.select(F.lit(src).alias("src"), F.col(f"{k}key").cast("string").alias("src_id"), F.concat_ws(":", F.lit(src), f"{k}key").alias("full_id"), F.col(f"{src[0]}_name").alias("name"), F.col(f"{src[0]}_nationkey").alias("nation"), F.col(f"{src[0]}_acctbal").alias("balance"), seg.alias("segment"))
    a = one(t(spark, d, "supplier"), "supplier", "s_supp", F.lit(None).cast("string"))
    return a.unionByName(one(t(spark, d, "customer"), "customer", "c_cust", F.col("c_mktsegment")))


@register(
    "proj_case_labels",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -2 WHEN o_totalprice > 150000 THEN o_custkey WHEN o_orderstatus = 'F' THEN -1 ELSE -3 END AS label,
 CASE WHEN o_totalprice > 200000 THEN 'A' WHEN o_totalprice > 100000 THEN 'B' WHEN o_totalprice > 50000 THEN 'C' ELSE 'none' END AS tier, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS final_price FROM orders""",
)
def proj_case_labels(spark, d):
    """Nested conditions, tiers, and a value masked to null outside its condition."""
    p = F.col("o_totalprice")
    label = F.when(F.col("o_orderstatus") == "P", -2).when(p > 150000, F.col("o_custkey")).when(F.col("o_orderstatus") == "F", -1).otherwise(-3)
    tier = F.when(p > 200000, "A").when(p > 100000, "B").when(p > 50000, "C").otherwise("none")
    return t(spark, d, "orders").select("o_orderkey", label.alias("label"), tier.alias("tier"), F.when(F.col("o_orderstatus") == "F", p).alias("final_price"))


@register(
    "proj_lookup_default",
    "SELECT p_partkey, COALESCE(CASE p_brand WHEN 'Brand#11' THEN 'alpha' WHEN 'Brand#12' THEN 'beta' WHEN 'Brand#23' THEN 'gamma' END, 'other') AS family, printf('P%05d', p_partkey) AS padded FROM part",
)
def proj_lookup_default(spark, d):
    names = F.create_map(*(F.lit(x) for kv in {"Brand#11": "alpha", "Brand#12": "beta", "Brand#23": "gamma"}.items() for x in kv))
    return t(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(names, F.col("p_brand")), F.lit("other")).alias("family"), F.format_string("P%05d", "p_partkey").alias("padded"))


@register(
    "proj_casts",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value) AS BIGINT) AS v, TRY_CAST(event_type AS BIGINT) AS bad FROM events""",
)
def proj_casts(spark, d):
    """Strict casts raise on a bad value, coercing ones give null."""
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.round("value").cast("bigint").alias("v"), F.col("event_type").try_cast("bigint").alias("bad"))


@register("proj_row_number", "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS BIGINT) AS k FROM supplier")
def proj_row_number(spark, d):
    w = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return t(spark, d, "supplier").select("s_suppkey", big(F.row_number().over(w) - 1, "k"))


@register("proj_fill_defaults", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS status, COALESCE(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END, 0.0) AS price FROM orders")
def proj_fill_defaults(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"))
    return o.fillna({"status": "none", "price": 0.0})


@register("proj_deny_list", "SELECT c_custkey AS export_custkey, c_nationkey AS export_nationkey, c_mktsegment AS export_mktsegment FROM customer")
def proj_deny_list(spark, d):
    """Columns on the deny list leave, the rest get the export's prefix."""
    kept = t(spark, d, "customer").drop("c_name", "c_acctbal")
    return kept.withColumnsRenamed({c: c.replace("c_", "export_", 1) for c in kept.columns})


# --- filters -------------------------------------------------------------------------------------------------------


@register("filter_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_membership(spark, d):
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(c, "o_custkey", "left_semi").select("o_orderkey")


@register("filter_range_box", "SELECT vec_id FROM embeddings WHERE embedding[1] * 1000 BETWEEN -50 AND 80 AND embedding[2] * 1000 >= -60 AND embedding[2] * 1000 <= 90")
def filter_range_box(spark, d):
    x, y = F.col("embedding")[0] * 1000, F.col("embedding")[1] * 1000
    return t(spark, d, "embeddings").where(x.between(-50, 80) & (y >= -60) & (y <= 90)).select("vec_id")


@register("filter_threshold_verdict", "SELECT l_suppkey, COUNT(*) AS n, CASE WHEN f <= 0.2 THEN 'agrees' WHEN f >= 0.8 THEN 'contradicts' ELSE 'mixed' END AS verdict FROM (SELECT l_suppkey, CASE WHEN COUNT(*) FILTER (l_returnflag <> 'N') > 0 THEN COUNT(*) FILTER (l_returnflag = 'R') * 1.0::DOUBLE / COUNT(*) FILTER (l_returnflag <> 'N') END AS f FROM lineitem GROUP BY 1) GROUP BY ALL")
def filter_threshold_verdict(spark, d):
    """A share that isn't defined fails both thresholds and is mixed."""
    share = F.try_divide(F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") != "N"))
    f = t(spark, d, "lineitem").groupBy("l_suppkey").agg(share.alias("f"))
    verdict = F.when(F.col("f") <= 0.2, "agrees").when(F.col("f") >= 0.8, "contradicts").otherwise("mixed")
    return f.withColumn("verdict", verdict).groupBy("l_suppkey", "verdict").agg(F.count("*").alias("n"))


@register("filter_variants", "SELECT v AS variant, COUNT(*) AS n FROM lineitem, (VALUES ('all'), ('strict'), ('fords')) q(v) WHERE v = 'all' OR (v = 'strict' AND l_quantity > 25) OR (v = 'fords' AND (l_returnflag = 'R' OR l_linestatus = 'O')) GROUP BY 1")
def filter_variants(spark, d):
    tests = {"all": F.lit(True), "strict": F.col("l_quantity") > 25, "fords": (F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O")}
    hit = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items())), lambda x: x.isNotNull())
    return t(spark, d, "lineitem").select(F.explode(hit).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"))


@register("filter_careful_set", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_tax = 0.08 AND l_returnflag = 'N')")
def filter_careful_set(spark, d):
    l = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag", "l_quantity", "l_tax")
    bad = l.where("l_quantity = 50 and l_tax = 0.08D and l_returnflag = 'N'")
    return t(spark, d, "supplier").where("s_acctbal > 0").join(l.where("l_returnflag = 'R'"), "s_suppkey", "left_semi").join(bad, "s_suppkey", "left_anti").select("s_suppkey")


@register("filter_schema_search", "SELECT 'l_shipdate' AS name, 'lineitem' AS tbl UNION ALL SELECT 'o_orderdate', 'orders'")
def filter_schema_search(spark, d):
    """Columns whose names fit a pattern, from the schemas alone."""
    import re

    found = [(c, n) for n in ("orders", "lineitem", "customer") for c in t(spark, d, n).columns if re.search(r"(?i)date", c)]
    return spark.createDataFrame(found, "name string, tbl string")


# --- joins ---------------------------------------------------------------------------------------------------------


def cust(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_nationkey")


def ords(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_orders"))


_C, _O = "(SELECT c_custkey AS custkey, c_name, c_nationkey FROM customer)", "(SELECT o_custkey AS custkey, COUNT(*) AS n_orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"

for _how in ("inner", "left", "right"):
    register(f"join_{_how}", f"SELECT custkey, c_name, n_orders FROM {_C} c {_how.upper()} JOIN {_O} o USING (custkey)")(lambda spark, d, how=_how: cust(spark, d).join(ords(spark, d), "custkey", how).select("custkey", "c_name", "n_orders"))


@register("join_full_indicator", f"SELECT custkey, c_name, n_orders, CASE WHEN c.l IS NULL THEN 'right_only' WHEN o.r IS NULL THEN 'left_only' ELSE 'both' END AS origin FROM (SELECT *, 1 AS l FROM {_C} WHERE c_nationkey > 4) c FULL JOIN (SELECT *, 1 AS r FROM {_O}) o USING (custkey)")
def join_full_indicator(spark, d):
    return rel.full_with_origin(cust(spark, d).where("c_nationkey > 4"), ords(spark, d), "custkey").select("custkey", "c_name", "n_orders", "origin")


@register("semi_join", f"SELECT custkey FROM {_C} WHERE custkey IN (SELECT custkey FROM {_O} WHERE n_orders > 2)")
def semi_join(spark, d):
    return cust(spark, d).join(ords(spark, d).where("n_orders > 2"), "custkey", "left_semi").select("custkey")


@register("anti_join", f"SELECT custkey FROM {_C} WHERE custkey NOT IN (SELECT custkey FROM {_O})")
def anti_join(spark, d):
    return cust(spark, d).join(ords(spark, d), "custkey", "left_anti").select("custkey")


_NK = "NULLIF(c_mktsegment, 'BUILDING')"


@register("null_safe_join", f"SELECT a.k, a.n, b.bal FROM (SELECT {_NK} AS k, c_nationkey AS nk, COUNT(*) AS n FROM customer GROUP BY 1, 2) a JOIN (SELECT {_NK} AS k, c_nationkey AS nk, round(SUM(c_acctbal), 2) AS bal FROM customer GROUP BY 1, 2) b ON a.k IS NOT DISTINCT FROM b.k AND a.nk = b.nk")
def null_safe_join(spark, d):
    c = t(spark, d, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("k"), F.col("c_nationkey").alias("nk"), "c_acctbal")
    a, b = c.groupBy("k", "nk").agg(F.count("*").alias("n")), c.groupBy("k", "nk").agg(F.round(F.sum("c_acctbal"), 2).alias("bal"))
    return rel.null_safe_join(a, b, ["k", "nk"]).select("k", "n", "bal")


@register("cardinality_guard", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def cardinality_guard(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return rel.guarded_join(t(spark, d, "orders"), c, "o_custkey", validate="m:1").select("o_orderkey", "c_mktsegment")


@register("map_back_default", "SELECT n_nationkey, COALESCE(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey")
def map_back_default(spark, d):
    n = t(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return rel.map_back(t(spark, d, "nation").select("n_nationkey"), n, "n_nationkey")


@register("self_compare", "SELECT a.l_orderkey, a.l_linenumber AS first_line, b.l_linenumber AS next_line, round(b.l_quantity - a.l_quantity, 6) AS change FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def self_compare(spark, d):
    l = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = l.select("l_orderkey", F.col("l_linenumber").alias("next_line"), F.col("l_quantity").alias("q2"))
    return l.join(b, "l_orderkey").where("next_line = l_linenumber + 1").select("l_orderkey", F.col("l_linenumber").alias("first_line"), "next_line", F.round(F.col("q2") - F.col("l_quantity"), 6).alias("change"))


_EDGES = """e AS (SELECT l_orderkey AS seg, l_linenumber AS edge_id, (l_linenumber - 1) / n::DOUBLE AS a0, l_linenumber / n::DOUBLE AS a1 FROM lineitem JOIN (SELECT l_orderkey, MAX(l_linenumber) AS n FROM lineitem GROUP BY 1) USING (l_orderkey)),
 p AS (SELECT o_orderkey AS seg, (o_custkey % 11) / 10.0::DOUBLE AS pos FROM orders)"""


@register("interval_locate", f"WITH {_EDGES} SELECT seg, pos, COALESCE(MIN(edge_id) FILTER (pos >= a0 - 1e-9 AND pos <= a1 + 1e-9), MIN(edge_id)) AS edge_id FROM p JOIN e USING (seg) GROUP BY 1, 2")
def interval_locate(spark, d):
    """Each place on its segment's sub-edge: the first that holds it, else the segment's first."""
    from terrafold.operators.spatial import located_edge

    l = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("seg_id"), F.col("l_linenumber").alias("edge_id"))
    n = l.groupBy("seg_id").agg(F.max("edge_id").alias("n"))
    e = l.join(n, "seg_id").select("seg_id", "edge_id", ((F.col("edge_id") - 1) / F.col("n")).alias("a0"), (F.col("edge_id") / F.col("n")).alias("a1"))
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("seg_id"), ((F.col("o_custkey") % 11) / F.lit(10.0)).alias("pos"))
    return located_edge(p, e).withColumnRenamed("seg_id", "seg")


@register("bridge_union_join", "SELECT k, side, n_name FROM (SELECT s_nationkey AS k, 's' AS side FROM supplier UNION SELECT c_nationkey, 'c' FROM customer) JOIN nation ON n_nationkey = k")
def bridge_union_join(spark, d):
    """Both ends of a link to their areas: two selects, distinct, one join."""
    u = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")).union(t(spark, d, "customer").select("c_nationkey", F.lit("c"))).distinct()
    return u.join(t(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).select("k", "side", "n_name")


# --- aggregates ----------------------------------------------------------------------------------------------------


@register("agg_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 4) AS qty, round(AVG(l_discount), 6) AS disc, COUNT(DISTINCT l_partkey) AS parts, MIN(l_shipdate) AS first_ship, MAX(l_quantity) AS top FROM lineitem GROUP BY 1, 2")
def agg_multi(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count_distinct("l_partkey").alias("parts"), F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").alias("top"))


@register("weighted_median_fill", "WITH c AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS v, c_nationkey + 1 AS w FROM customer), m AS (SELECT median(v) AS m FROM c) SELECT round(SUM(COALESCE(v, m) * w) / SUM(w), 6) AS wavg FROM c, m")
def weighted_median_fill(spark, d):
    c = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"), (F.col("c_nationkey") + 1).alias("w"))
    return rel.weighted_mean_filled(c, "v", "w").select(F.round("wavg", 6).alias("wavg"))


@register("weighted_mean_region_fill", "WITH c AS (SELECT c_nationkey % 5 AS r, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS v, c_nationkey + 1 AS w FROM customer), m AS (SELECT r, SUM(v * w) / SUM(w) FILTER (v IS NOT NULL) AS m FROM c GROUP BY 1) SELECT r, round(AVG(COALESCE(v, m)), 6) AS mean FROM c JOIN m USING (r) GROUP BY 1")
def weighted_mean_region_fill(spark, d):
    c = t(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("r"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"), (F.col("c_nationkey") + 1).alias("w"))
    m = c.groupBy("r").agg(sc.weighted_mean("v", "w").alias("m"))
    return c.join(m, "r").groupBy("r").agg(F.round(F.avg(F.coalesce("v", "m")), 6).alias("mean"))


@register("rate_per_100k", "SELECT c_nationkey, round(1e5 * COUNT(*) FILTER (c_mktsegment = 'BUILDING') / COUNT(*), 4) AS rate FROM customer GROUP BY 1")
def rate_per_100k(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.try_divide(1e5 * F.count_if(F.col("c_mktsegment") == "BUILDING"), F.count("*")), 4).alias("rate"))


@register("mode_low_tie", "SELECT k, v FROM (SELECT o_custkey AS k, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY COUNT(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def mode_low_tie(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.mode("o_orderpriority", True).alias("v"))


@register("any_all", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r, bool_and(l_linestatus = 'O') AS all_o, COUNT(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def any_all(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_r"), F.bool_and(F.col("l_linestatus") == "O").alias("all_o"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


_NULLS = "NULLIF(l_returnflag, 'N') AS flag, CASE WHEN l_quantity > 20 THEN l_quantity END AS qty, CASE WHEN l_discount > 0.04 THEN l_discount END AS disc"


def _null_columns():
    return ["l_orderkey", "l_linenumber", "l_extendedprice", F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.when(F.col("l_quantity") > 20, F.col("l_quantity")).alias("qty"), F.when(F.col("l_discount") > 0.04, F.col("l_discount")).alias("disc")]


@register("first_non_null_columns", f"SELECT l_orderkey, {', '.join(f'arg_min({c}, (l_linenumber, l_extendedprice)) FILTER ({c} IS NOT NULL) AS {c}' for c in ('flag', 'qty', 'disc'))} FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, {_NULLS} FROM lineitem) GROUP BY 1")
def first_non_null_columns(spark, d):
    """Of lines that tie in number and price the first as stored, as in the SQL run by one thread; with more threads its own pick varies."""
    lines = t(spark, d, "lineitem").select(*_null_columns(), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rel.first_non_null(lines, "l_orderkey", ["l_linenumber", "l_extendedprice", "file", "row"], ["flag", "qty", "disc"])


@register("sorted_distinct_concat", "SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '|' ORDER BY CAST(l_suppkey AS VARCHAR)) AS as_text, string_agg(CAST(s AS VARCHAR), '|' ORDER BY s) AS as_number FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_suppkey AS s FROM lineitem) GROUP BY 1")
def sorted_distinct_concat(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(rel.sorted_concat("l_suppkey").alias("as_text"), rel.sorted_concat("l_suppkey", numeric=True).alias("as_number"))


@register("crosstab", "SELECT o_orderpriority AS p, COUNT(*) FILTER (o_orderstatus = 'F') AS F, COUNT(*) FILTER (o_orderstatus = 'O') AS O, COUNT(*) FILTER (o_orderstatus = 'X') AS X FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def crosstab(spark, d):
    return rel.crosstab(t(spark, d, "orders").withColumnRenamed("o_orderpriority", "p"), "p", "o_orderstatus", ["F", "O", "X"])


@register("unstack", "SELECT * FROM (PIVOT (SELECT l_returnflag AS flag, l_linestatus AS ls, l_quantity AS q FROM lineitem) ON ls IN ('F', 'O') USING round(SUM(q), 4) GROUP BY flag)")
def unstack(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 4))


@register("quantiles", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY 1")
def quantiles(spark, d):
    q = lambda p: F.round(F.percentile("l_extendedprice", F.lit(p)), 4)
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.median("l_extendedprice"), 4).alias("med"), q(0.25).alias("q25"), q(0.9).alias("q90"))


@register("qcut4", "WITH q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= q[1] THEN 'Q1' WHEN c_acctbal <= q[2] THEN 'Q2' WHEN c_acctbal <= q[3] THEN 'Q3' ELSE 'Q4' END AS bin FROM customer, q")
def qcut4(spark, d):
    return rel.quartile_labels(t(spark, d, "customer"), "c_acctbal").select("c_custkey", "bin")


@register("unnest_count", "SELECT w, COUNT(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def unnest_count(spark, d):
    return t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@register("value_counts", "SELECT k, COUNT(*) AS n FROM (SELECT NULLIF(event_type, 'click') AS k FROM events) WHERE k IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(spark, d):
    return rel.value_counts(t(spark, d, "events").select(F.nullif("event_type", F.lit("click")).alias("k")), "k")


@register("group_min_size_first", "SELECT o_custkey, MIN(o_totalprice) AS low, COUNT(*) AS n, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS first_key FROM orders GROUP BY 1")
def group_min_size_first(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), F.count("*").alias("n"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("first_key"))


@register("histogram_argmax", "SELECT 'rows' AS weight, l_suppkey FROM (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) UNION ALL SELECT 'quantity', l_suppkey FROM (SELECT l_suppkey, SUM(l_quantity) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")
def histogram_argmax(spark, d):
    """The fullest bin by rows and by a weight; ties go to the lower key."""
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))
    best = g.agg(*(F.max_by("l_suppkey", F.struct(c, -F.col("l_suppkey"))).alias(c) for c in ("rows", "quantity")))
    return best.select(F.expr("stack(2, 'rows', rows, 'quantity', quantity) AS (weight, l_suppkey)"))


@register("exact_sum", "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice * 100 AS DECIMAL(20, 0))) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def exact_sum(spark, d):
    """A sum that no order of rows changes: as decimals."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(big(F.sum((F.col("l_extendedprice") * 100).cast("decimal(20,0)")), "cents"))


@register("grand_total", "SELECT COALESCE(CAST(n_regionkey AS VARCHAR), 'TOTAL') AS region, COUNT(*) AS nations, CAST(SUM(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY ROLLUP (n_regionkey)")
def grand_total(spark, d):
    n = t(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("region"), F.lit(1).cast("bigint").alias("nations"), F.col("n_nationkey").cast("bigint").alias("keys"))
    return rel.with_total(n, "region", ["nations", "keys"])


@register("summary_bag", "SELECT COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'F') AS done, COUNT(*) FILTER (o_totalprice > 100000 AND o_orderpriority = '1-URGENT') AS large_urgent, COUNT(DISTINCT o_custkey) AS customers, round(SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_value, round(AVG(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 4) AS mean_high FROM orders")
def summary_bag(spark, d):
    """Many measures in one pass."""
    c = F.col
    return t(spark, d, "orders").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("done"), F.count_if((c("o_totalprice") > 100000) & (c("o_orderpriority") == "1-URGENT")).alias("large_urgent"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum(F.when(c("o_orderstatus") == "O", c("o_totalprice")).otherwise(0)), 2).alias("open_value"), F.round(F.avg(F.when(c("o_orderpriority") == "2-HIGH", c("o_totalprice"))), 4).alias("mean_high"))


@register("share_of_footprint", "WITH n AS (SELECT s_nationkey AS k, COUNT(*) AS nb FROM supplier GROUP BY 1), p AS (SELECT c_nationkey AS k, SUM(c_acctbal) AS pop FROM customer GROUP BY 1) SELECT s_suppkey, CASE WHEN nb > 0 THEN round(pop / nb, 4) END AS people FROM supplier JOIN n ON k = s_nationkey LEFT JOIN p USING (k)")
def share_of_footprint(spark, d):
    """An area's people shared equally among its buildings."""
    s = t(spark, d, "supplier").withColumnRenamed("s_nationkey", "k")
    n = s.groupBy("k").agg(F.count("*").alias("nb"))
    p = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("pop"))
    return s.join(n, "k").join(p, "k", "left").select("s_suppkey", F.round(F.try_divide("pop", "nb"), 4).alias("people"))


@register("occupancy", "SELECT n_regionkey, round(SUM(o) / NULLIF(COUNT(*), 0), 6) AS per_home, COUNT(*) FILTER (o = 0) AS empty_homes, COUNT(*) FILTER (o >= 15) AS full_homes FROM (SELECT c_custkey, n_regionkey, COUNT(o_orderkey) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def occupancy(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"))
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, "c_custkey", "left").fillna(0, ["o"])
    return c.groupBy("n_regionkey").agg(F.round(F.try_divide(F.sum("o"), F.count("*")), 6).alias("per_home"), F.count_if(F.col("o") == 0).alias("empty_homes"), F.count_if(F.col("o") >= 15).alias("full_homes"))


# --- window-like ---------------------------------------------------------------------------------------------------


@register("first_by_order", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def first_by_order(spark, d):
    return rel.first_row(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("dup_flag", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate FROM documents")
def dup_flag(spark, d):
    return t(spark, d, "documents").select("doc_id", (F.row_number().over(W.partitionBy(F.sha2("text", 256)).orderBy("doc_id")) > 1).alias("duplicate"))


@register("adjacent_pairs", "SELECT * FROM (SELECT l_orderkey AS seg, l_partkey AS u, lead(l_partkey) OVER w AS v, l_linenumber AS a0, lead(l_linenumber) OVER w AS a1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE v IS NOT NULL")
def adjacent_pairs(spark, d):
    from terrafold.operators.graph import sub_edges

    return sub_edges(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("seg"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("node")), "seg")


@register("adjacent_pairs_of_arrays", "SELECT * FROM (SELECT l_orderkey AS seg_id, l_partkey AS u, lead(l_partkey) OVER w AS v, l_linenumber AS a0, lead(l_linenumber) OVER w AS a1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE v IS NOT NULL")
def adjacent_pairs_of_arrays(spark, d):
    """The same where a segment's row holds its connectors."""
    from terrafold.operators.graph import sub_edges_of_arrays

    c = F.collect_list(F.struct(F.col("l_partkey").alias("connector_id"), F.col("l_linenumber").alias("at")))
    return sub_edges_of_arrays(t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seg_id")).agg(c.alias("connectors")))


@register("neighbour_frame", "SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS roles FROM conversations")
def neighbour_frame(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ">").alias("roles"))


@register("asymmetric_frame", "SELECT conv_id, turn, CASE WHEN COUNT(*) OVER (PARTITION BY conv_id) <= 6 THEN MAX(length(text)) OVER (PARTITION BY conv_id) ELSE MAX(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) END AS longest FROM conversations")
def asymmetric_frame(spark, d):
    """One before to two after; the whole group where it has six rows at most."""
    p = W.partitionBy("conv_id")
    n = F.length("text")
    longest = F.when(F.count("*").over(p) <= 6, F.max(n).over(p)).otherwise(F.max(n).over(p.orderBy("turn").rowsBetween(-1, 2)))
    return t(spark, d, "conversations").select("conv_id", "turn", longest.cast("bigint").alias("longest"))


@register("ntile_strata", "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS stratum FROM supplier")
def ntile_strata(spark, d):
    """Equal strata of a bounded list of areas; the global order is the feature."""
    return t(spark, d, "supplier").select("s_suppkey", F.ntile(4).over(W.orderBy("s_acctbal", "s_suppkey")).cast("bigint").alias("stratum"))


@register("top3_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def top3_per_key(spark, d):
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@register("best_by_rule", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, (o_orderpriority = '1-URGENT') DESC, o_orderkey) = 1")
def best_by_rule(spark, d):
    """The row with the lexicographically best tuple of rules."""
    rule = F.struct(F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT", -F.col("o_orderkey"))
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rule).alias("o_orderkey"))


@register("greedy_separation", "WITH RECURSIVE p AS (SELECT s_nationkey AS g, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r FROM supplier), t(g, r, taken) AS (SELECT g, r, [x] FROM p WHERE r = 1 UNION ALL SELECT p.g, p.r, CASE WHEN len(taken) < 3 AND p.x - taken[-1] >= 300 THEN list_append(taken, p.x) ELSE taken END FROM t JOIN p ON p.g = t.g AND p.r = t.r + 1) SELECT g, arg_max(taken, r) AS taken FROM t GROUP BY 1")
def greedy_separation(spark, d):
    """Up to three of the sorted candidates, each 300 or more from those taken."""
    xs = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_acctbal", "s_suppkey"))), lambda s: s["s_acctbal"]).alias("xs"))
    far = lambda acc, x: (F.size(acc) < 3) & F.forall(acc, lambda y: F.abs(x - y) >= 300)
    taken = F.aggregate("xs", F.array().cast("array<double>"), lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return xs.select("g", taken.alias("taken"))


@register("share_of_group", "SELECT o_orderkey, round(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def share_of_group(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(W.partitionBy("o_custkey")), 6).alias("share"))


# --- sorts, limits, sets -------------------------------------------------------------------------------------------


@register("sort_mixed", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey")
def sort_mixed(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy(F.desc("c_nationkey"), "c_acctbal", "c_custkey")


@register("top8", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top8(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(8)


@register("sort_by_class", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey")
def sort_by_class(spark, d):
    order = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy(order, "o_orderkey")


@register("set_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union_distinct(spark, d):
    return t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(t(spark, d, "customer").select("c_nationkey")).distinct()


@register("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@register("set_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_intersection(spark, d):
    l = t(spark, d, "lineitem")
    return l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(l.where("l_quantity > 45").select("l_partkey"))


@register("array_sets", "SELECT a.l_orderkey, len(list_intersect(pa, pb)) AS shared, len(list_filter(pa, lambda x: NOT list_contains(pb, x))) = 0 AS subset FROM (SELECT l_orderkey, list(DISTINCT l_suppkey) AS pa FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_orderkey, list(DISTINCT l_suppkey) AS pb FROM lineitem WHERE l_quantity > 10 GROUP BY 1) b USING (l_orderkey)")
def array_sets(spark, d):
    """Shared members and the subset test on arrays."""
    l = t(spark, d, "lineitem")
    a, b = (l.where(w).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias(n)) for w, n in (("l_returnflag = 'R'", "pa"), ("l_quantity > 10", "pb")))
    return a.join(b, "l_orderkey").select("l_orderkey", big(F.size(F.array_intersect("pa", "pb")), "shared"), (F.size(F.array_except("pa", "pb")) == 0).alias("subset"))


@register("combine_first", "SELECT k, COALESCE(a.v, b.v) AS v, COALESCE(a.w, b.w) AS w FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS v, c_mktsegment AS w FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT c_custkey AS k, -1.0::DOUBLE AS v, 'fill' AS w FROM customer WHERE c_acctbal > 1000) b USING (k)")
def combine_first(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    a = c.where("c_mktsegment <> 'BUILDING'").select("k", F.when(F.col("k") % 2 == 0, F.col("c_acctbal")).alias("v"), F.col("c_mktsegment").alias("w"))
    return rel.combine_first(a, c.where("c_acctbal > 1000").select("k", F.lit(-1.0).alias("v"), F.lit("fill").alias("w")), "k")


# --- dates ---------------------------------------------------------------------------------------------------------


@register("date_build", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || printf('%02d:%02d', (o_orderkey % 2400) // 100 % 24, o_orderkey % 60) AS stamp, date_part('year', o_orderdate) AS y FROM orders")
def date_build(spark, d):
    """A stamp from year-month, day and an unpadded HHMM."""
    ym, day = F.date_format("o_orderdate", "yyyyMM"), F.dayofmonth("o_orderdate")
    hh, mm = F.floor((F.col("o_orderkey") % 2400) / 100) % 24, F.col("o_orderkey") % 60
    stamp = F.concat(F.substring(ym, 1, 4), F.lit("-"), F.substring(ym, 5, 2), F.lit("-"), F.format_string("%02d %02d:%02d", day, hh, mm))
    return t(spark, d, "orders").select("o_orderkey", stamp.alias("stamp"), F.year("o_orderdate").cast("bigint").alias("y"))


@register("date_cutoff", "SELECT event_id, ts >= TIMESTAMP '2024-01-01 12:00:00' AS late FROM events")
def date_cutoff(spark, d):
    return t(spark, d, "events").select("event_id", (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00'")).alias("late"))


@register("period_counts", "SELECT COUNT(*) FILTER (y <= 1994) AS to_1994, COUNT(*) FILTER (y BETWEEN 1995 AND 1996) AS mid, COUNT(*) FILTER (y > 1996) AS later FROM (SELECT date_part('year', o_orderdate) AS y FROM orders)")
def period_counts(spark, d):
    y = F.year("o_orderdate")
    return t(spark, d, "orders").agg(F.count_if(y <= 1994).alias("to_1994"), F.count_if(y.between(1995, 1996)).alias("mid"), F.count_if(y > 1996).alias("later"))


# --- arrays, maps, JSON --------------------------------------------------------------------------------------------


@register("nested_flatten", "SELECT o AS l_orderkey, string_agg(DISTINCT f, '|' ORDER BY f) AS flags, COUNT(*) AS n, arg_min(r, (k, r)) AS first_flag FROM (SELECT l_orderkey AS o, l_linenumber AS k, l_returnflag AS r, unnest([l_returnflag, l_linestatus]) AS f FROM lineitem) GROUP BY 1")
def nested_flatten(spark, d):
    """Distinct sorted values of arrays within arrays, their number, and the first that matches."""
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array("l_returnflag", "l_linestatus").alias("v")))).alias("x"))
    flat = F.flatten(F.transform("x", lambda r: r["v"]))
    return g.select("l_orderkey", F.array_join(F.array_sort(F.array_distinct(flat)), "|").alias("flags"), big(F.size(flat), "n"), F.get(flat, F.lit(0)).alias("first_flag"))


@register("array_first_match", "SELECT l_orderkey, list_filter(list(l_suppkey ORDER BY l_linenumber, l_suppkey), lambda x: x % 2 = 0)[1] AS first_even, COALESCE(len(list(l_suppkey)), 0) AS n FROM lineitem GROUP BY 1")
def array_first_match(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("xs"))
    return g.select("l_orderkey", F.get(F.filter("xs", lambda x: x % 2 == 0), F.lit(0)).alias("first_even"), big(F.coalesce(F.size("xs"), F.lit(0)), "n"))


@register("range_scoped", "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) FILTER (l_linenumber % 4 = 0 OR ((l_linenumber - 1) / 7.0::DOUBLE - 0.02 <= 0.3 AND l_linenumber / 7.0::DOUBLE + 0.02 >= 0.3)) AS at_03 FROM lineitem GROUP BY 1")
def range_scoped(spark, d):
    """Values of a segment that hold at a position: those without a range, and those whose range covers it, with room of 0.02."""
    between = F.when(F.col("l_linenumber") % 4 != 0, F.array((F.col("l_linenumber") - 1) / F.lit(7.0), F.col("l_linenumber") / F.lit(7.0)))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", between.alias("between")))).alias("flags"))
    holds = F.filter("flags", lambda f: f["between"].isNull() | ((f["between"][0] - 0.02 <= 0.3) & (f["between"][1] + 0.02 >= 0.3)))
    return g.select("l_orderkey", F.when(F.size(holds) > 0, F.array_join(F.transform(holds, lambda f: f["l_returnflag"]), "")).alias("at_03"))


@register("array_contains_run", "SELECT doc_id, text LIKE '% of the %' AS has FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[ \\n\\t]+', ' ', 'g') || ' ' AS text FROM documents)")
def array_contains_run(spark, d):
    """A contiguous run of words within an array."""
    words = F.split(F.regexp_replace(F.lower("text"), r"[ \n\t]+", " "), " ")
    return t(spark, d, "documents").select("doc_id", contains_run(words, F.array(F.lit("of"), F.lit("the"))).alias("has"))


@register("json_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"e\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS packed FROM events")
def json_fields(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("e"), F.col("event_type").alias("t"))).alias("packed"))


@register("string_int_list", "SELECT l_orderkey, list_transform(string_split(string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey), ' '), lambda x: CAST(x AS BIGINT)) AS ids FROM lineitem GROUP BY 1")
def string_int_list(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), " ").alias("s"))
    return g.select("l_orderkey", F.transform(F.split("s", " "), lambda x: x.cast("bigint")).alias("ids"))


@register("pad_and_prefix", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS geoid, substr(lpad(CAST(c_custkey AS VARCHAR), 11, '0'), 1, 5) AS county, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM customer")
def pad_and_prefix(spark, d):
    g = pad_id("c_custkey")
    return t(spark, d, "customer").select("c_custkey", g.alias("geoid"), F.substring(g, 1, 5).alias("county"), F.initcap(F.lower("c_mktsegment")).alias("title"))


@register("number_norm", "SELECT s, upper(regexp_replace(s, '^0+([0-9])', '\\1')) AS n FROM (VALUES ('0042'), ('12a'), ('000'), ('7')) v(s)")
def number_norm_query(spark, d):
    return spark.createDataFrame([("0042",), ("12a",), ("000",), ("7",)], "s string").select("s", number_norm("s").alias("n"))


# --- quality -------------------------------------------------------------------------------------------------------


@register("table_difference", "SELECT k, 'left' AS only FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT k, 'right' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def table_difference(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return rel.difference(o.where("o_orderstatus = 'F'").select("k"), o.where("o_orderstatus = 'O'").select("k"))


@register("cell_differences", "SELECT s_suppkey, 'bal' AS \"column\", CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) AS \"left\", CAST(CAST(s_acctbal AS BIGINT) + 1 AS VARCHAR) AS \"right\" FROM supplier WHERE s_suppkey % 10 = 0")
def cell_differences(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.rint("s_acctbal").cast("bigint").alias("bal"), "s_nationkey")
    other = s.withColumn("bal", F.when(F.col("s_suppkey") % 10 == 0, F.col("bal") + 1).otherwise(F.col("bal")))
    return rel.cell_differences(s, other, "s_suppkey", ["bal", "s_nationkey"])


@register("required_columns", "SELECT 'lineitem' AS tbl, 0 AS missing UNION ALL SELECT 'orders', 1")
def required_columns(spark, d):
    need = {"lineitem": ["l_orderkey", "l_shipdate"], "orders": ["o_orderkey", "o_comment"]}
    return spark.createDataFrame([(n, len(quality.missing_columns(t(spark, d, n), c))) for n, c in need.items()], "tbl string, missing int")


@register("published_counts", "SELECT 'nation' AS tbl, 25::BIGINT AS n, TRUE AS holds UNION ALL SELECT 'region', 5::BIGINT, TRUE")
def published_counts(spark, d):
    return quality.count_checks({n: t(spark, d, n) for n in ("nation", "region")}, {"nation": 25, "region": 5})


@register("attach_strata", "SELECT o_orderkey, c_mktsegment AS segment, n_regionkey AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def attach_strata(spark, d):
    s = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a list of nations
    s = s.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("region"))
    return t(spark, d, "orders").join(s, "o_custkey", "left").select("o_orderkey", "segment", "region")
