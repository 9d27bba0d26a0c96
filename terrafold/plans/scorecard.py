"""Coverage-gap scorecard over nations: counts, components, composite, and the sweep of conventions."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import scoring as sc
from terrafold.operators.tables import table
from terrafold.registry import register

# What is counted for each nation, by table; the stand-ins of the observed and the reference side.
SUPPLIERS = {
    "ovt_bldg": "CASE WHEN s_acctbal > 7000 THEN 1 ELSE 0 END",
    "ms_bldg": "CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END",
    "ovt_bldg_bbox": "CASE WHEN s_acctbal > 7200 THEN 1 ELSE 0 END",
    "ms_bldg_bbox": "CASE WHEN s_acctbal > 5200 THEN 1 ELSE 0 END",
    "ovt_bldg_int": "CASE WHEN s_acctbal > 6800 THEN 1 ELSE 0 END",
    "ms_bldg_int": "CASE WHEN s_acctbal > 4800 THEN 1 ELSE 0 END",
    "ovt_bldg_parts": "CASE WHEN s_acctbal > 9000 THEN 2 WHEN s_acctbal > 7000 THEN 1 ELSE 0 END",
    "ms_bldg_parts": "CASE WHEN s_acctbal > 9000 THEN 2 WHEN s_acctbal > 5000 THEN 1 ELSE 0 END",
}
LINES = {
    "ovt_road": "CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END",
    "tig_road": "CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END",
    "ovt_road_mid": "CASE WHEN l_returnflag = 'R' AND l_linenumber <= 4 THEN l_quantity ELSE 0 END",
    "tig_road_mid": "CASE WHEN l_returnflag = 'A' AND l_linenumber <= 4 THEN l_quantity ELSE 0 END",
    "ovt_road_ll": "CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE 0 END",
    "tig_road_ll": "CASE WHEN l_returnflag = 'A' THEN l_quantity + 1 ELSE 0 END",
    "ovt_road_geo": "CASE WHEN l_returnflag = 'R' THEN l_quantity + 2 ELSE 0 END",
    "tig_road_geo": "CASE WHEN l_returnflag = 'A' THEN l_quantity + 2 ELSE 0 END",
    "ovt_road_tertiary": "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END",
    "tig_road_s1630": "CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN l_quantity ELSE 0 END",
}
CLASSES = {"fire": "1-URGENT", "ems": "2-HIGH", "school": "3-MEDIUM"}
ORDERS = {
    **{f"ovt_{k}": f"CASE WHEN o_orderpriority = '{p}' AND o_orderstatus = 'F' THEN 1 ELSE 0 END" for k, p in CLASSES.items()},
    **{f"ref_{k}": f"CASE WHEN o_orderpriority = '{p}' AND o_orderstatus = 'O' THEN 1 ELSE 0 END" for k, p in CLASSES.items()},
    **{f"ovt_{k}_within": f"CASE WHEN o_orderpriority = '{p}' AND o_orderstatus = 'F' AND o_totalprice > 20000 THEN 1 ELSE 0 END" for k, p in CLASSES.items()},
    "ovt_places": "1",
    "ovt_places_within": "CASE WHEN o_totalprice > 20000 THEN 1 ELSE 0 END",
    "ovt_places_nonnull": "CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END",
}
CUSTOMERS = {"cbp_estab": "c_acctbal / 1000", "cbp_estab_res": "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal / 1000 ELSE 0 END"}


def counts(spark: SparkSession, d: str) -> DataFrame:
    """One row per nation of the authoritative list, every count 0 where nothing was found.

    Each fact table is summed up by its own key before it meets the nations: four partial aggregates, small joins.
    """
    sums = lambda spec: [F.sum(F.expr(e).cast("double")).alias(k) for k, e in spec.items()]
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region"))
    suppliers, customers = table(spark, d, "supplier"), table(spark, d, "customer")
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*sums(LINES)).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(*sums(ORDERS)).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    found = [
        suppliers.groupBy(F.col("s_nationkey").alias("area")).agg(*sums(SUPPLIERS)),
        lines.groupBy(F.col("s_nationkey").alias("area")).agg(*(F.sum(k).alias(k) for k in LINES)),
        orders.groupBy(F.col("c_nationkey").alias("area")).agg(*(F.sum(k).alias(k) for k in ORDERS)),
        customers.groupBy(F.col("c_nationkey").alias("area")).agg(*sums(CUSTOMERS)),
    ]
    return reduce(lambda x, y: x.join(y, "area", "left"), found, nation).fillna(0)


def _sums(spec: dict[str, str]) -> str:
    return ", ".join(f"SUM(CAST({e} AS DOUBLE)) AS {k}" for k, e in spec.items())


_ALL = {**SUPPLIERS, **LINES, **ORDERS, **CUSTOMERS}
COUNTS_SQL = f"""counts AS (
 SELECT n_nationkey AS area, n_regionkey AS region, {", ".join(f"COALESCE({k}, 0) AS {k}" for k in _ALL)} FROM nation
 LEFT JOIN (SELECT s_nationkey AS a, {_sums(SUPPLIERS)} FROM supplier GROUP BY 1) s ON s.a = n_nationkey
 LEFT JOIN (SELECT s_nationkey AS a, {_sums(LINES)} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) l ON l.a = n_nationkey
 LEFT JOIN (SELECT c_nationkey AS a, {_sums(ORDERS)} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.a = n_nationkey
 LEFT JOIN (SELECT c_nationkey AS a, {_sums(CUSTOMERS)} FROM customer GROUP BY 1) c ON c.a = n_nationkey)"""


# --- the same expressions as SQL text, for the oracles ------------------------------------------------------------


def sql_gap(o: str, r: str, cap: bool = True) -> str:
    ratio = f"({o})::DOUBLE / ({r})"
    return f"(CASE WHEN ({r}) > 0 THEN 1 - {f'LEAST(1.0, {ratio})' if cap else ratio} END)"


def sql_mean(*xs: str) -> str:
    n = " + ".join(f"(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END)" for x in xs)
    return f"(({' + '.join(f'COALESCE({x}, 0.0::DOUBLE)' for x in xs)}) / NULLIF({n}, 0))"


def sql_round(x: str, places: int = 6) -> str:
    return f"(round_even(({x}) * 1e{places}::DOUBLE, 0) / 1e{places}::DOUBLE)"


def sql_part(part: sc.Part, cap: bool) -> str:
    if isinstance(part, tuple):
        return sql_mean(*(sql_part(x, cap) for x in part))
    found = sql_gap(part.observed, part.reference, cap)
    return found if part.undefined is None else f"COALESCE({found}, {part.undefined}::DOUBLE)"


def sql_composite(c: sc.Convention = sc.Convention()) -> str:
    parts = [sql_round(x) if c.rounded_parts else x for x in (sql_part(p, c.capped) for p in c.parts)]
    zero = lambda x: f"COALESCE({x}, 0.0::DOUBLE)"
    whole = zero(sql_mean(*parts) if c.divisor is None else f"(({' + '.join(map(zero, parts))}) / {c.divisor}::DOUBLE)")
    whole = f"GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, {whole}))" if c.capped else whole
    return whole if c.decimals is None else sql_round(whole, c.decimals)


SCORED = sc.Convention()
#: The parts of a convention by their places.
T, B, P = 0, 1, 2
#: The ways to bring facilities and places together.
POI = {
    "halves": (sc.facilities(), sc.PLACES),
    "flat4": (*sc.facilities(), sc.PLACES),
    "no_ems": (sc.facilities(kinds=("fire", "school")), sc.PLACES),
    "fire": (*sc.facilities(kinds=("fire",)), sc.PLACES),
}
#: The sweep: (group, name, convention), each with one thing changed in the scored one.
VARIANTS: list[tuple[str, str, sc.Convention]] = [
    ("roads", "midpoint", SCORED.like(T, sc.Gap("ovt_road_mid", "tig_road_mid"))),
    ("roads", "split_lonlat", SCORED.like(T, sc.Gap("ovt_road_ll", "tig_road_ll"))),
    ("roads", "geodesic", SCORED.like(T, sc.Gap("ovt_road_geo", "tig_road_geo"))),
    ("roads", "tertiary", SCORED.like(T, sc.Gap("ovt_road + ovt_road_tertiary", "tig_road"))),
    ("roads", "ramps", SCORED.like(T, sc.Gap("ovt_road", "tig_road + tig_road_s1630"))),
    ("buildings", "bbox_centre", SCORED.like(B, sc.Gap("ovt_bldg_bbox", "ms_bldg_bbox"))),
    ("buildings", "touching", SCORED.like(B, sc.Gap("ovt_bldg_int", "ms_bldg_int"))),
    ("buildings", "parts", SCORED.like(B, sc.Gap("ovt_bldg_parts", "ms_bldg_parts"))),
    ("places", "within", SCORED.like(P, (sc.facilities("_within"), sc.Gap("ovt_places_within", "cbp_estab")))),
    ("places", "nonnull", SCORED.like(P, (sc.facilities(), sc.Gap("ovt_places_nonnull", "cbp_estab")))),
    ("weighting", "residential", SCORED.like(P, (sc.facilities(), sc.Gap("ovt_places", "cbp_estab_res")))),
    ("weighting", "flat4", SCORED.like(P, POI["flat4"])),
    ("weighting", "undefined_zero", SCORED.like(P, (sc.facilities(undefined=0.0), sc.PLACES))),
    ("weighting", "no_ems", SCORED.like(P, POI["no_ems"])),
    ("weighting", "fire", SCORED.like(P, POI["fire"])),
    ("weighting", "divisor_three", replace(SCORED, divisor=3.0)),
    ("weighting", "uncapped", replace(SCORED, capped=False)),
    ("output", "round_components", replace(SCORED, rounded_parts=True)),
    ("output", "full_precision", replace(SCORED, decimals=None)),
]


SCORE_SQL = f"""SELECT area, region, {sql_round(sql_gap('ovt_road', 'tig_road'))} AS transport_gap, {sql_round(sql_gap('ovt_bldg', 'ms_bldg'))} AS building_gap,
 {sql_round(sql_mean(sql_mean(*(sql_gap(f'ovt_{k}', f'ref_{k}') for k in sc.CATS)), sql_gap('ovt_places', 'cbp_estab')))} AS poi_gap, {sql_composite()} AS coverage_gap_score FROM counts"""


@register("gap_score_nation", f"WITH {COUNTS_SQL} {SCORE_SQL}")
def gap_score_nation(spark: SparkSession, d: str) -> DataFrame:
    return scored(counts(spark, d))


def scored(df: DataFrame) -> DataFrame:
    poi = sc.mean_defined(sc.mean_defined(*(sc.gap(f"ovt_{k}", f"ref_{k}") for k in sc.CATS)), sc.gap("ovt_places", "cbp_estab"))
    return df.select("area", "region", sc.round_even(sc.gap("ovt_road", "tig_road")).alias("transport_gap"), sc.round_even(sc.gap("ovt_bldg", "ms_bldg")).alias("building_gap"), sc.round_even(poi).alias("poi_gap"), sc.composite().alias("coverage_gap_score"))


@register("gap_basic", f"WITH {COUNTS_SQL} SELECT area, {sql_round(sql_gap('ovt_bldg', 'ms_bldg'))} AS gap FROM counts")
def gap_basic(spark, d):
    return counts(spark, d).select("area", sc.round_even(sc.gap("ovt_bldg", "ms_bldg")).alias("gap"))


@register("gap_uncapped", f"WITH {COUNTS_SQL} SELECT area, {sql_round(sql_gap('ovt_places', 'cbp_estab', False))} AS gap FROM counts")
def gap_uncapped(spark, d):
    return counts(spark, d).select("area", sc.round_even(sc.gap("ovt_places", "cbp_estab", cap=False)).alias("gap"))


@register("gap_mean_defined", f"WITH {COUNTS_SQL} SELECT area, {sql_round(sql_mean(sql_gap('ovt_bldg', 'ms_bldg'), sql_gap('ovt_road', 'tig_road'), sql_gap('ovt_places', 'cbp_estab')))} AS mean_gap FROM counts")
def gap_mean_defined(spark, d):
    return counts(spark, d).select("area", sc.round_even(sc.mean_defined(sc.gap("ovt_bldg", "ms_bldg"), sc.gap("ovt_road", "tig_road"), sc.gap("ovt_places", "cbp_estab"))).alias("mean_gap"))


@register("gap_divisor_three", f"WITH {COUNTS_SQL} SELECT area, {sql_composite(replace(SCORED, divisor=3.0))} AS score FROM counts")
def gap_divisor_three(spark, d):
    return counts(spark, d).select("area", sc.composite(sc.Convention(divisor=3.0)).alias("score"))


@register("gap_poi_modes", f"WITH {COUNTS_SQL} SELECT area, {', '.join(f'{sql_composite(SCORED.like(P, p))} AS {m}' for m, p in POI.items())} FROM counts")
def gap_poi_modes(spark, d):
    return _named(counts(spark, d), {m: SCORED.like(P, p) for m, p in POI.items()})


def _named(df: DataFrame, conventions: dict[str, sc.Convention]) -> DataFrame:
    found = df.select("area", sc.composites(list(conventions.values())).alias("v"))
    return found.select("area", *(F.col("v")[i].alias(k) for i, k in enumerate(conventions)))


def sweep(df: DataFrame, variants=VARIANTS, moved: float = 1e-12) -> DataFrame:
    """Every variant against the scored conventions, in one pass: ``(grp, variant, moved, mean_change, max_change)``."""
    names = F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(n).alias("variant")) for g, n, _ in variants))
    each = df.select(sc.composites([SCORED, *(c for _, _, c in variants)]).alias("v")).select(F.posexplode("v").alias("i", "x"), F.col("v")[0].alias("base")).where("i > 0")
    each = each.select(F.get(names, F.col("i") - 1).alias("n"), F.abs(F.col("x") - F.col("base")).alias("change")).select("n.*", "change")
    return each.groupBy("grp", "variant").agg(F.count_if(F.col("change") > moved).alias("moved"), F.avg("change").alias("mean_change"), F.max("change").alias("max_change"))


_CHANGES = " UNION ALL ".join(f"SELECT '{g}' AS grp, '{n}' AS variant, ABS({sql_composite(c)} - {sql_composite()}) AS change FROM counts" for g, n, c in VARIANTS)


def _verdict(threshold: float):
    return F.when(F.col("moved") == 0, "identical").when(F.col("mean_change") > 2 * threshold, "ruled out").otherwise("passes")


@register(
    "sweep_variants",
    f"""WITH {COUNTS_SQL}, c AS ({_CHANGES}), g AS (SELECT grp, variant, COUNT(*) FILTER (change > 1e-12) AS moved, AVG(change) AS mean_change, MAX(change) AS max_change FROM c GROUP BY 1, 2)
 SELECT grp, variant, moved, round(mean_change, 9) AS mean_change, round(max_change, 9) AS max_change,
 CASE WHEN moved = 0 THEN 'identical' WHEN mean_change > 0.02 THEN 'ruled out' ELSE 'passes' END AS verdict FROM g""",
)
def sweep_variants(spark, d):
    out = sweep(counts(spark, d)).withColumn("verdict", _verdict(0.01))
    return out.select("grp", "variant", "moved", F.round("mean_change", 9).alias("mean_change"), F.round("max_change", 9).alias("max_change"), "verdict")


@register("component_flags", f"""WITH {COUNTS_SQL} SELECT area, COALESCE({sql_round(sql_gap('ovt_road', 'tig_road'))}, 0) AS transport_gap, tig_road > 0 AS t_def, COALESCE({sql_round(sql_gap('ovt_bldg', 'ms_bldg'))}, 0) AS building_gap, ms_bldg > 0 AS b_def FROM counts""")
def component_flags(spark, d):
    """Components with undefined ones stored as 0 beside the flags that tell."""
    keep = lambda o, r, n, f: (F.coalesce(sc.round_even(sc.gap(o, r)), F.lit(0.0)).alias(n), (F.col(r) > 0).alias(f))
    return counts(spark, d).select("area", *keep("ovt_road", "tig_road", "transport_gap", "t_def"), *keep("ovt_bldg", "ms_bldg", "building_gap", "b_def"))


@register(
    "stratum_ratio",
    f"""WITH {COUNTS_SQL}, s AS (SELECT *, {sql_composite()} AS score FROM counts), m AS (SELECT median(cbp_estab) AS med FROM s)
 SELECT round(AVG(score) FILTER (cbp_estab > med) / AVG(score) FILTER (cbp_estab <= med), 6) AS ratio_median_split,
 round(AVG(score) FILTER (region IN (0, 1)) / AVG(score) FILTER (region NOT IN (0, 1)), 6) AS ratio_flag FROM s, m""",
)
def stratum_ratio(spark, d):
    s = counts(spark, d).withColumn("score", sc.composite())
    s = s.join(F.broadcast(s.agg(F.median("cbp_estab").alias("med"))))  # one row
    ratio = lambda t: F.round(F.try_divide(F.avg(F.when(t, F.col("score"))), F.avg(F.when(~t, F.col("score")))), 6)
    return s.agg(ratio(F.col("cbp_estab") > F.col("med")).alias("ratio_median_split"), ratio(F.col("region").isin(0, 1)).alias("ratio_flag"))


@register(
    "acceptance_window",
    f"""WITH {COUNTS_SQL}, s AS (SELECT {sql_composite()} AS score FROM counts) SELECT round(SUM(CAST(score AS DECIMAL(20, 6)))::DOUBLE, 6) AS total, COUNT(*) AS n,
 SUM(CAST(score AS DECIMAL(20, 6)))::DOUBLE BETWEEN (0.25 - 0.2) * COUNT(*) AND (0.25 + 0.2) * COUNT(*) AS inside FROM s""",
)
def acceptance_window(spark, d):
    """Whether the sum lies within n times a published mean and its rounding; summed as decimals, so in any order alike."""
    total = F.sum(F.col("score").cast("decimal(20,6)")).cast("double")
    return counts(spark, d).select(sc.composite().alias("score")).agg(F.round(total, 6).alias("total"), F.count("*").alias("n"), total.between((0.25 - 0.2) * F.count("*"), (0.25 + 0.2) * F.count("*")).alias("inside"))


@register("attribute_gap", f"WITH {COUNTS_SQL} SELECT region, {sql_round('1 - LEAST(1.0::DOUBLE, SUM(ovt_fire) / NULLIF(SUM(ref_fire), 0))')} AS gap FROM counts GROUP BY 1")
def attribute_gap(spark, d):
    g = counts(spark, d).groupBy("region").agg(F.sum("ovt_fire").alias("o"), F.sum("ref_fire").alias("r"))
    return g.select("region", sc.round_even(sc.gap("o", "r")).alias("gap"))


GEO_VARIANTS = {
    "dedup_roads": SCORED.like(T, sc.Gap("ovt_road - ovt_road_mid / 10", "tig_road")),
    "dedup_buildings": SCORED.like(B, sc.Gap("ovt_bldg - ovt_bldg_parts / 10", "ms_bldg")),
    "crs_spelling": SCORED,
    "facility_predicate": SCORED.like(P, (sc.facilities("_within"), sc.PLACES)),
    "one_area_place": SCORED.like(P, (sc.facilities(), sc.Gap("ovt_places_nonnull", "cbp_estab"))),
    "open_place": SCORED.like(P, (sc.facilities(), sc.Gap("ovt_places_within", "cbp_estab"))),
    "point_on_surface": SCORED.like(B, sc.Gap("ovt_bldg_int", "ms_bldg_int")),
    "projected_centroid": SCORED.like(B, sc.Gap("ovt_bldg_bbox", "ms_bldg_bbox")),
}


@register("sweep_geometry_variants", f"WITH {COUNTS_SQL} SELECT area, {', '.join(f'{sql_composite(c)} AS {n}' for n, c in GEO_VARIANTS.items())} FROM counts")
def sweep_geometry_variants(spark, d):
    return _named(counts(spark, d), GEO_VARIANTS)


@register("fixed_width_report", f"WITH {COUNTS_SQL}, s AS (SELECT CAST(area AS VARCHAR) AS a, printf('%.6f', {sql_composite()}) AS v FROM counts), w AS (SELECT MAX(length(a)) AS wa, MAX(length(v)) AS wv FROM s) SELECT rpad(a, wa::INTEGER, ' ') || '  ' || lpad(v, wv::INTEGER, ' ') AS line FROM s, w")
def fixed_width_report(spark, d):
    """Text columns as wide as their longest value."""
    s = counts(spark, d).select(F.col("area").cast("string").alias("a"), F.format_string("%.6f", sc.composite()).alias("v"))
    w = s.agg(F.max(F.length("a")).alias("wa"), F.max(F.length("v")).alias("wv"))
    return s.join(F.broadcast(w)).select(F.concat(F.expr("rpad(a, wa, ' ')"), F.lit("  "), F.expr("lpad(v, wv, ' ')")).alias("line"))  # one row
