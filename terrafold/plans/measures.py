"""Services, files, tiles, near misses and the remaining measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geometry as geo
from terrafold.operators import graph, quality, resample, spatial
from terrafold.operators.tables import scratch_path
from terrafold.operators.tables import table as t
from terrafold.plans.places import _LL, LINE_SQL, POINTS_SQL, areas, points, short_lines
from terrafold.plans.scorecard import COUNTS_SQL, counts, scored, sql_composite
from terrafold.registry import register
from terrafold.sources import files, readers, sinks

# --- services and files -----------------------------------------------------------------------------------------------


def blocks_page(offset, limit, envelope):
    """A stand-in for a service of 400 square blocks, which answers those that meet an envelope."""
    xmin, ymin, xmax, ymax = envelope
    met = [(k, k % 20 * 10.0, k // 20 * 10.0) for k in range(400) if k % 20 * 10 <= xmax and k % 20 * 10 + 10 >= xmin and k // 20 * 10 <= ymax and k // 20 * 10 + 10 >= ymin]
    if offset is None:
        return len(met)
    return [(k, k * 3 % 50, [[{"x": x, "y": y}, {"x": x + 10, "y": y}, {"x": x + 10, "y": y + 10}, {"x": x, "y": y + 10}, {"x": x, "y": y}]]) for k, x, y in met[offset : offset + limit]]


@register("envelope_query", "SELECT k AS block, k * 3 % 50 AS people, 100.0::DOUBLE AS area FROM range(400) r(k) WHERE k % 20 * 10 BETWEEN 15 AND 75 AND k // 20 * 10 BETWEEN 30 AND 112")
def envelope_query(spark, d):
    """Polygons and attributes within an envelope that the service applies, a page a partition."""
    spark.dataSource.register(readers.PagedSource)
    box = spark.read.format("paged").option("fetch", "terrafold.plans.measures:blocks_page").option("schema", "block bigint, people bigint, rings array<array<struct<x:double,y:double>>>").option("page", "15").option("envelope", "25,40,75,112").load()
    return box.select("block", "people", F.round(F.abs(geo.ring_area(F.get("rings", F.lit(0)))), 6).alias("area"))


@register("service_sums", "SELECT k % 7 AS county, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS homes FROM range(1000) r(k) GROUP BY 1")
def service_sums(spark, d):
    """Sums that a service groups itself, asked once and kept."""
    ask = lambda: [{"county": c, "n": len(range(c, 1000, 7)), "homes": sum(range(c, 1000, 7))} for c in range(7)]
    path, schema = scratch_path(spark, "sums"), "county bigint, n bigint, homes bigint"
    files.cached_answer(spark, path, schema, ask)

    def again():
        raise OSError("asked twice")

    return files.cached_answer(spark, path, schema, again)


@register("glob_class_box", "SELECT vec_id FROM embeddings WHERE label IN (1, 2) AND 1000 * embedding[1]::DOUBLE + 5 >= -50 AND 1000 * embedding[1]::DOUBLE - 5 <= 60")
def glob_class_box(spark, d):
    """Many folders by a glob, filtered by class and box in the files, few columns."""
    root = scratch_path(spark, "themes")
    x = F.col("embedding")[0].cast("double") * 1000
    box = F.struct((x - 5).alias("xmin"), (x + 5).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("ymax"))
    e = t(spark, d, "embeddings").select("vec_id", F.col("label").alias("class"), box.alias("bbox"))
    for k in range(2):
        sinks.write_parquet(e.where(F.col("vec_id") % 2 == k), f"{root}/type={k}/part")
    return readers.scan(spark, f"{root}/type=*/*", None, (-50.0, 60.0, 0.0, 1.0)).where(F.col("class").isin(1, 2)).select("vec_id")


@register("region_inputs", f"SELECT n_name AS region, COUNT(*) AS files FROM nation, range({len(files.REGION_FILES)}) GROUP BY 1")
def region_inputs(spark, d):
    """Every file that a run over the regions reads."""
    names = [r.n_name for r in t(spark, d, "nation").select("n_name").collect()]  # the list of regions
    return files.inputs(spark, names).groupBy("region").agg(F.count_distinct("file").alias("files"))


@register("snapshot_copy", "SELECT r_regionkey, r_name FROM region")
def snapshot_copy(spark, d):
    """A table written compressed, copied, and read from the copy."""
    path, to = scratch_path(spark, "original"), scratch_path(spark, "snapshot")
    sinks.write_parquet(t(spark, d, "region").select("r_regionkey", "r_name"), path, compression="zstd")
    return spark.read.parquet(files.snapshot(spark, [path], to)[0])


@register("template_fill", "SELECT k, 'area ' || k || ' has ' || n || ' customers' AS line FROM (SELECT n_nationkey AS k, COUNT(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def template_fill(spark, d):
    """A template filled for each row of a result of a known small size."""
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = t(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n")).collect()
    return spark.createDataFrame([(r.n_nationkey, sinks.fill("area {{K}} has {{N}} customers", {"K": r.n_nationkey, "N": r.n})) for r in rows], "k int, line string")


@register("tag_rule", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 IN (2, 3) OR o_orderstatus = 'P' OR o_orderpriority LIKE '%URGENT%'")
def tag_rule(spark, d):
    """A tag that is there and not "no", or one that says yes, or one that holds a word."""
    ford = F.when(F.col("o_orderkey") % 4 > 0, F.when(F.col("o_orderkey") % 4 == 1, "no").otherwise("yes"))
    rule = F.coalesce(ford != "no", F.lit(False)) | (F.col("o_orderstatus") == "P") | F.col("o_orderpriority").contains("URGENT")
    return t(spark, d, "orders").where(rule).select("o_orderkey")


@register("position_join", "SELECT n_nationkey AS key, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def position_join(spark, d):
    """Two column sets of one file, brought together by file and row number."""
    path = scratch_path(spark, "positions")
    t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("region")).repartition(3).write.parquet(path)
    p = readers.with_position(spark.read.parquet(path))
    return p.select("file", "row", "key", "name").join(p.select("file", "row", "region"), ["file", "row"]).select("key", "name", "region")


# --- networks and shapes ----------------------------------------------------------------------------------------------


@register(
    "longest_component",
    f"""WITH {POINTS_SQL}, {LINE_SQL}, s AS (SELECT line_id AS comp, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM segs) SELECT comp, round(SUM(len), 4) AS size FROM s GROUP BY 1 ORDER BY SUM(len) DESC LIMIT 1""",
)
def longest_component(spark, d):
    """The component with most length, by a sum over its pieces; here each label's pieces hang together."""
    s = short_lines(spark, d).select(F.col("line_id").alias("node"), "label", geo.length("line").alias("len"))
    w = s.groupBy("label").agg(F.min("node").alias("first"))
    edges = s.join(w, "label").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    found = graph.labelled(s.select("node"), edges).join(s, "node")
    top = graph.largest(found, "len")
    return top.join(s.select(F.col("node").alias("comp"), "label"), "comp").select(F.col("label").alias("comp"), F.round("size", 4).alias("size"))


@register("near_miss_flags", f"WITH {POINTS_SQL}, {LINE_SQL}, q AS (SELECT a.line_id AS comp, a.sid AS one, b.sid AS two, {_LL} AS dist FROM segs a, segs b WHERE a.line_id < 5 AND b.line_id >= 5) SELECT g AS comp, bool_or(dist <= 10) AS within_10, bool_or(dist <= 20) AS within_20, bool_or(dist <= 40) AS within_40, round(MIN(dist) FILTER (dist <= 20), 6) AS closest FROM (SELECT DISTINCT line_id AS g FROM segs WHERE line_id < 5) LEFT JOIN q ON comp = g AND dist <= 40 GROUP BY 1")
def near_miss_flags(spark, d):
    """Cut-off groups with a main line within 10, 20 and 40 m, and the closest pair's distance, measured between its two points."""
    s = short_lines(spark, d)
    one, two = s.where("label < 5").withColumnRenamed("line_id", "one"), s.where("label >= 5").withColumnRenamed("line_id", "two")
    near = spatial.pieces_near_pieces(one.withColumn("comp", F.col("label")), two, 40.0, "one", "two", keep=("comp",))
    best = near.groupBy("comp").agg(F.min(F.struct("dist", "one", "two")).alias("n"))
    best = best.select("comp", "n.*").join(one.select("one", F.col("line").alias("p")), "one").join(two.select("two", F.col("line").alias("q")), "two")
    best = best.select("comp", "dist", geo.closest_points("p", "q").alias("c"))
    apart = F.hypot(F.col("c.p.x") - F.col("c.q.x"), F.col("c.p.y") - F.col("c.q.y"))
    groups = one.select(F.col("label").alias("comp")).distinct().join(best, "comp", "left")
    return groups.select("comp", *(F.when(F.col("dist").isNotNull(), F.col("dist") <= r).alias(f"within_{r}") for r in (10, 20, 40)), F.when(F.col("dist") <= 20, F.round(apart, 6)).alias("closest"))


@register("box_centres", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT sid AS id, round((ax + bx) / 2, 9) AS x, round((ay + by_) / 2, 9) AS y FROM segs")
def box_centres(spark, d):
    """Centres of the boxes of all pieces."""
    c = geo.bbox_centre(geo.bbox("line"))
    return short_lines(spark, d).select(F.col("line_id").alias("id"), F.round(c["x"], 9).alias("x"), F.round(c["y"], 9).alias("y"))


@register("located_points", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT id, sid AS line_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))), 6) AS pos FROM pts JOIN segs ON id = sid + 2")
def located_points(spark, d):
    """Where on a piece the point two further on comes nearest, from 0 to 1."""
    s = short_lines(spark, d)
    p = points(spark, d).select((F.col("id") - 2).alias("line_id"), "id", "x", "y")
    return p.join(s, "line_id").select("id", "line_id", F.round(geo.locate(geo.point("x", "y"), "line"), 6).alias("pos"))


@register("exploded_parts", "SELECT area, COUNT(*) AS parts FROM (VALUES (1), (2), (3), (4), (4)) v(area) GROUP BY 1")
def exploded_parts(spark, d):
    """A shape of several parts is a row a part."""
    return areas(spark).select("area", F.explode("rings").alias("ring")).groupBy("area").agg(F.count("*").alias("parts"))


@register(
    "square_tiles",
    f"""WITH {POINTS_SQL}, b AS (SELECT label, MIN(x) - 20 AS x0, MAX(x) + 20 AS x1, MIN(y) - 20 AS y0, MAX(y) + 20 AS y1 FROM pts GROUP BY 1), n AS (SELECT *, greatest(1, ceil((x1 - x0) / 50))::BIGINT AS nx, greatest(1, ceil((y1 - y0) / 50))::BIGINT AS ny FROM b),
 ts AS (SELECT label, x0, y0, cx, unnest(range(ny)) AS cy FROM (SELECT *, unnest(range(nx)) AS cx FROM n)) SELECT label, cx, cy, round(x0 + cx * 50, 6) AS xmin, round(y0 + cy * 50, 6) AS ymin FROM ts""",
)
def square_tiles(spark, d):
    """Squares of 50 over each label's points and a margin of 20."""
    box = F.struct(*(f(c).alias(c + n) for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))))
    tiles = points(spark, d).groupBy("label").agg(box.alias("b")).select("label", F.explode(geo.square_tiles("b", 50.0, 20.0)).alias("s"))
    return tiles.select("label", F.col("s.cx").cast("long").alias("cx"), F.col("s.cy").cast("long").alias("cy"), F.round("s.xmin", 6).alias("xmin"), F.round("s.ymin", 6).alias("ymin"))


# --- estimates, checks, reports ---------------------------------------------------------------------------------------


@register("stratified_bootstrap")
def stratified_bootstrap(spark, d):
    """A total by strata with its interval, each stratum's rows drawn within it."""
    s = t(spark, d, "supplier").select((F.col("s_nationkey") % 4).alias("st"), (F.col("s_acctbal") > 4000).cast("double").alias("ok"))
    totals = {r.st: r.n for r in t(spark, d, "customer").groupBy((F.col("c_nationkey") % 4).alias("st")).agg(F.count("*").alias("n")).collect()}
    return resample.interval(resample.stratified_bootstrap(s, "st", "ok", totals), above=0.0)


@register("same_bits", "SELECT c_custkey, c_acctbal * 0.1::DOUBLE = c_acctbal / 10 AS same FROM customer")
def same_bits(spark, d):
    """Whether two ways to one number give the same bits."""
    return t(spark, d, "customer").select("c_custkey", quality.same_bits(F.col("c_acctbal") * F.lit(0.1), F.col("c_acctbal") / 10).alias("same"))


@register("control_first", f"WITH {COUNTS_SQL} SELECT COUNT(*) AS areas, round(MAX({sql_composite()}), 6) AS top FROM counts")
def control_first(spark, d):
    """A variant counts only after its recomputed base equals the table that it stands for."""
    c = counts(spark, d)
    base = scored(c)
    quality.assert_same(base, scored(c.select(*reversed(c.columns))), "scores")
    return base.agg(F.count("*").alias("areas"), F.round(F.max("coverage_gap_score"), 6).alias("top"))


@register(
    "named_examples",
    """SELECT n_name AS area, COUNT(*) AS n_cross, string_agg(s_name || ' (' || s_suppkey || ')', '; ' ORDER BY s_suppkey) AS crossings, bool_or(s_acctbal > 9000) AS tagged FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def named_examples(spark, d):
    """Areas with their crossings by name in one line; an area's crossings are a short list by nature."""
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.concat("s_name", F.lit(" ("), F.col("s_suppkey").cast("string"), F.lit(")"))
    g = s.groupBy(F.col("n_name").alias("area")).agg(F.count("*").alias("n_cross"), F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("c"), F.bool_or(F.col("s_acctbal") > 9000).alias("tagged"))
    return g.select("area", "n_cross", F.array_join(F.transform("c", lambda x: x["line"]), "; ").alias("crossings"), "tagged")
