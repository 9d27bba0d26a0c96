"""Spatial joins, geometry measures and networks, on points from the vectors' first two coordinates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geometry as geo
from terrafold.operators import graph, spatial
from terrafold.operators.relational import first_row
from terrafold.operators.tables import table as t
from terrafold.registry import register

POINTS_SQL = "pts AS (SELECT vec_id AS id, label, 1000 * embedding[1]::DOUBLE AS x, 1000 * embedding[2]::DOUBLE AS y FROM embeddings)"


def points(spark, d):
    e = lambda i: (F.col("embedding")[i].cast("double") * 1000)
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", e(0).alias("x"), e(1).alias("y"))


def twin(p, *names):
    return p.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), *names)


#: Areas: two rectangles that share a side, a triangle, and a square with a hole.
AREAS = {
    1: [[(-200, -200), (0, -200), (0, 100), (-200, 100), (-200, -200)]],
    2: [[(0, -200), (200, -200), (200, 100), (0, 100), (0, -200)]],
    3: [[(-150, 100), (150, 100), (0, 300), (-150, 100)]],
    4: [[(-400, -400), (400, -400), (400, 400), (-400, 400), (-400, -400)], [(-100, -100), (-100, 100), (100, 100), (100, -100), (-100, -100)]],
}


def areas(spark):
    rows = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in AREAS.items()]
    return spark.createDataFrame(rows, "area int, rings array<array<struct<x:double,y:double>>>")


_SEGS = ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, rings in AREAS.items() for ring in rings for a, b in zip(ring, ring[1:]))
_PD = "sqrt(pow(x - ax - tt * (bx - ax), 2) + pow(y - ay - tt * (by_ - ay), 2))"
_TT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))))"
PIP_SQL = f"""segs(area, ax, ay, bx, by_) AS (VALUES {_SEGS}), every AS (SELECT id, x, y FROM q),
 hits AS (SELECT id, area, COUNT(*) FILTER ((ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / (CASE WHEN by_ = ay THEN 1 ELSE by_ - ay END)) % 2 = 1 AS inside, MIN({_PD}) <= 1e-9 AS edge
  FROM (SELECT *, {_TT} AS tt FROM every, segs) GROUP BY 1, 2)"""
#: Points with some exactly on a boundary or a corner.
EDGE_SQL = "q AS (SELECT id, x, y FROM pts UNION ALL SELECT * FROM (VALUES (-1, 0.0::DOUBLE, 0.0::DOUBLE), (-2, 0.0::DOUBLE, 100.0::DOUBLE), (-3, -200.0::DOUBLE, -200.0::DOUBLE), (-4, 100.0::DOUBLE, 50.0::DOUBLE), (-5, 75.0::DOUBLE, 200.0::DOUBLE)))"
EDGE_POINTS = [(-1, 0.0, 0.0), (-2, 0.0, 100.0), (-3, -200.0, -200.0), (-4, 100.0, 50.0), (-5, 75.0, 200.0)]


def edge_points(spark, d):
    return points(spark, d).select("id", "x", "y").union(spark.createDataFrame(EDGE_POINTS, "id long, x double, y double"))


@register("pip_count", f"WITH {POINTS_SQL}, {EDGE_SQL}, {PIP_SQL} SELECT a AS area, COUNT(id) AS n FROM (VALUES (1), (2), (3), (4)) v(a) LEFT JOIN (SELECT * FROM hits WHERE inside AND NOT edge) ON area = a GROUP BY 1")
def pip_count(spark, d):
    """Points strictly within each area; areas without any stay on the list."""
    met = spatial.points_in_polygons(edge_points(spark, d), areas(spark), 100.0).groupBy("area").agg(F.count("*").alias("n"))
    return areas(spark).select("area").join(met, "area", "left").fillna(0)


@register("pip_boundary_multi", f"WITH {POINTS_SQL}, {EDGE_SQL}, {PIP_SQL} SELECT id, area FROM hits WHERE inside OR edge")
def pip_boundary_multi(spark, d):
    """A point on a shared boundary counts in every area."""
    return spatial.points_in_polygons(edge_points(spark, d), areas(spark), 100.0, predicate="intersects").select("id", "area")


@register("pip_touches", f"WITH {POINTS_SQL}, {EDGE_SQL}, {PIP_SQL} SELECT id, area FROM hits WHERE edge")
def pip_touches(spark, d):
    return spatial.points_in_polygons(edge_points(spark, d), areas(spark), 100.0, predicate="touches").select("id", "area")


@register("pip_lowest_key", f"WITH {POINTS_SQL}, {EDGE_SQL}, {PIP_SQL} SELECT id, MIN(area) AS area FROM hits WHERE inside OR edge GROUP BY 1")
def pip_lowest_key(spark, d):
    met = spatial.points_in_polygons(edge_points(spark, d), areas(spark), 100.0, predicate="intersects")
    return spatial.one_polygon_per_point(met, "id", "area").select("id", "area")


@register("distance_join", f"WITH {POINTS_SQL} SELECT a.id, b.id AS id2, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS dist FROM pts a, pts b WHERE a.id < b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 900")
def distance_join(spark, d):
    p = points(spark, d)
    return spatial.distance_join(p, twin(p), 30.0).where("id < id2").select("id", "id2", F.round("dist", 6).alias("dist"))


RADII = (10, 20, 40)


@register("distance_tags", f"WITH {POINTS_SQL} SELECT a.id, {', '.join(f'bool_or(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {r * r}) AS within_{r}' for r in RADII)} FROM pts a JOIN pts b ON a.id <> b.id GROUP BY 1")
def distance_tags(spark, d):
    """Near-miss flags at several radii from one join at the largest."""
    p = points(spark, d)
    near = spatial.distance_join(p, twin(p), float(RADII[-1])).where("id <> id2").groupBy("id").agg(F.min("dist").alias("dist"))
    near = p.select("id").join(near, "id", "left")
    return near.select("id", *(F.coalesce(F.col("dist") <= r, F.lit(False)).alias(f"within_{r}") for r in RADII))


@register("cross_source_duplicates", f"WITH {POINTS_SQL} SELECT id, EXISTS (SELECT 1 FROM pts b WHERE b.label < 5 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400) AS duplicate FROM pts a WHERE label >= 5")
def cross_source_duplicates(spark, d):
    """Points of the second source with any of the first within reach; neither source is compared with itself."""
    p = points(spark, d)
    one, two = p.where("label < 5"), p.where("label >= 5")
    hit = spatial.distance_join(two, twin(one), 20.0).select("id").distinct().withColumn("hit", F.lit(True))
    return two.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("duplicate"))


@register("nearest_neighbour", f"WITH {POINTS_SQL} SELECT id, id2, round(dist, 6) AS dist FROM (SELECT a.id, b.id AS id2, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM pts a JOIN pts b ON a.label <> b.label) WHERE dist <= 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, id2) = 1")
def nearest_neighbour(spark, d):
    p = points(spark, d)
    near = spatial.distance_join(p, twin(p, F.col("label").alias("label2")), 60.0).where("label <> label2")
    return first_row(near, ["id"], ["dist", "id2"]).select("id", "id2", F.round("dist", 6).alias("dist"))


@register("nearest_unbounded", f"WITH {POINTS_SQL} SELECT a.id, arg_min(b.id, (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id)) AS id2 FROM pts a JOIN pts b ON b.label = 3 WHERE a.label = 1 GROUP BY 1")
def nearest_unbounded(spark, d):
    """However far: rings of doubling radius for the points that have none yet."""
    p = points(spark, d)
    return spatial.nearest_unbounded(p.where("label = 1"), twin(p.where("label = 3")), 20.0, "id", "id2").select("id", "id2")


@register("nearest_unbounded_all", f"WITH {POINTS_SQL} SELECT a.id, arg_min(b.id, (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id)) AS id2 FROM pts a JOIN pts b ON a.label <> b.label GROUP BY 1")
def nearest_unbounded_all(spark, d):
    """The nearest point of any other label, for every point."""
    p = points(spark, d)
    other = twin(p, F.col("label").alias("label2"))
    return spatial.nearest_unbounded(p, other, 20.0, "id", "id2", where="label <> label2").select("id", "id2")


@register("nearest_tie", "WITH p AS (SELECT vec_id AS id, label, CAST(round(1000 * embedding[1] / 50) AS BIGINT) * 50.0::DOUBLE AS x, CAST(round(1000 * embedding[2] / 50) AS BIGINT) * 50.0::DOUBLE AS y FROM embeddings), m AS (SELECT a.id, b.id AS id2, b.label, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON a.id <> b.id) SELECT id, COUNT(*) AS n_ties, COUNT(DISTINCT label) AS n_labels, MIN(id2) AS lowest, round(MIN(dist), 6) AS dist FROM m WHERE dist <= 100 QUALIFY 1 = 1 GROUP BY id, dist HAVING dist = (SELECT MIN(dist) FROM m z WHERE z.id = m.id)".replace(" QUALIFY 1 = 1", ""))
def nearest_tie(spark, d):
    """All nearest at the least distance, the labels among them, and the lowest id."""
    snap = lambda i: F.round(F.col("embedding")[i] * 1000 / 50).cast("long") * 50.0
    p = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", snap(0).alias("x"), snap(1).alias("y"))
    near = spatial.distance_join(p.drop("label"), twin(p, "label"), 100.0).where("id <> id2")
    near = near.withColumn("r", F.rank().over(W.partitionBy("id").orderBy("dist"))).where("r = 1")
    return near.groupBy("id").agg(F.count("*").alias("n_ties"), F.count_distinct("label").alias("n_labels"), F.min("id2").alias("lowest"), F.round(F.min("dist"), 6).alias("dist"))


@register("named_of_nearest5", f"WITH {POINTS_SQL}, m AS (SELECT a.id, b.id AS id2, b.label, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM pts a JOIN pts b ON a.id <> b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 3600 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) <= 5) SELECT id, id2, round(dist, 6) AS dist FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY label <> 2, dist, id2) = 1")
def named_of_nearest5(spark, d):
    """Of the five nearest, one with the wanted name first, else the nearest."""
    p = points(spark, d)
    near = spatial.nearest(p.drop("label"), twin(p, "label").withColumnRenamed("label", "label2"), 60.0, "id", "id2", k=6).where("id <> id2")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("dist", "id2"))).where("r <= 5")
    return first_row(near, ["id"], [F.col("label2") != 2, "dist", "id2"]).select("id", "id2", F.round("dist", 6).alias("dist"))


# --- lines -----------------------------------------------------------------------------------------------------------

LINE_SQL = "segs AS (SELECT * FROM (SELECT label AS line_id, id AS sid, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM pts WINDOW w AS (PARTITION BY label ORDER BY id)) WHERE bx IS NOT NULL)"


def lines(spark, d):
    """One line per label through its points in the order of their ids."""
    p = points(spark, d)
    g = p.groupBy(F.col("label").alias("line_id")).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("s"))
    return g.select("line_id", F.transform("s", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line")).where("size(line) > 1")


def short_lines(spark, d):
    """The pieces of those lines, each a line of its own."""
    w = W.partitionBy("label").orderBy("id")
    p = points(spark, d).select("id", "label", "x", "y", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    return p.select(F.col("id").alias("line_id"), "label", F.array(geo.point("x", "y"), geo.point("bx", "by")).alias("line"))


@register("line_length", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT line_id, round(SUM(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))), 4) AS len FROM segs GROUP BY 1")
def line_length(spark, d):
    return lines(spark, d).select("line_id", F.round(geo.length("line"), 4).alias("len"))


@register("point_line_distance", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT id, line_id, round(MIN({_PD}), 6) AS dist FROM (SELECT p.id, p.x, p.y, s.*, {_TT} AS tt FROM pts p JOIN segs s ON p.label <> s.line_id) WHERE {_PD} <= 10 GROUP BY 1, 2")
def point_line_distance(spark, d):
    p = points(spark, d)
    near = spatial.lines_near_points(p, lines(spark, d), 10.0, "id", "line_id")
    return near.join(p.select("id", "label"), "id").where("label <> line_id").select("id", "line_id", F.round("dist", 6).alias("dist"))


def _pd(px, py, ax, ay, bx, by):
    tt = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))))"
    return f"sqrt(pow({px} - {ax} - {tt} * ({bx} - {ax}), 2) + pow({py} - {ay} - {tt} * ({by} - {ay}), 2))"


_A, _B = ("a.ax", "a.ay", "a.bx", "a.by_"), ("b.ax", "b.ay", "b.bx", "b.by_")
_CR = lambda o, p, q: f"(({p[0]} - {o[0]}) * ({q[1]} - {o[1]}) - ({p[1]} - {o[1]}) * ({q[0]} - {o[0]}))"
_P = [("a.ax", "a.ay"), ("a.bx", "a.by_"), ("b.ax", "b.ay"), ("b.bx", "b.by_")]
_LL = f"CASE WHEN {_CR(_P[0], _P[1], _P[2])} * {_CR(_P[0], _P[1], _P[3])} < 0 AND {_CR(_P[2], _P[3], _P[0])} * {_CR(_P[2], _P[3], _P[1])} < 0 THEN 0.0 ELSE least({_pd(*_P[0], *_B)}, {_pd(*_P[1], *_B)}, {_pd(*_P[2], *_A)}, {_pd(*_P[3], *_A)}) END"


def _rounded(near):
    """The limit holds for the rounded distance."""
    return near.select("one", "two", F.round("dist", 6).alias("dist")).where("dist <= 10")


@register("line_line_distance", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT * FROM (SELECT a.sid AS one, b.sid AS two, round({_LL}, 6) AS dist FROM segs a, segs b WHERE a.line_id = 0 AND b.line_id = 1) WHERE dist <= 10")
def line_line_distance(spark, d):
    s = short_lines(spark, d)
    one, two = s.where("label = 0").withColumnRenamed("line_id", "one"), s.where("label = 1").withColumnRenamed("line_id", "two")
    return _rounded(spatial.lines_near_lines(one, two, 10.0 + 1e-6, "one", "two"))


@register("line_line_distance_all", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT * FROM (SELECT a.sid AS one, b.sid AS two, round({_LL}, 6) AS dist FROM segs a, segs b WHERE a.line_id < b.line_id) WHERE dist <= 10")
def line_line_distance_all(spark, d):
    """Pieces of any two labels. Each line is one piece, so a pair comes once and nothing is left to sum up."""
    s = short_lines(spark, d)
    one, two = (s.select(F.col("line_id").alias(k), F.col("label").alias(f"label_{k}"), "line") for k in ("one", "two"))
    near = spatial.pieces_near_pieces(one, two, 10.0 + 1e-6, "one", "two", keep=("label_one",), keep_two=("label_two",), where="label_one < label_two")
    return _rounded(near)


_RECT = (-200.0, 0.0, -200.0, 100.0)


@register(
    "clip_length",
    f"""WITH {POINTS_SQL}, {LINE_SQL}, c AS (SELECT line_id, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len,
  greatest(0, least(tx0, tx1), least(ty0, ty1)) AS lo, least(1, greatest(tx0, tx1), greatest(ty0, ty1)) AS hi FROM
  (SELECT *, (-200.0::DOUBLE - ax) / (bx - ax) AS tx0, (0.0::DOUBLE - ax) / (bx - ax) AS tx1, (-200.0::DOUBLE - ay) / (by_ - ay) AS ty0, (100.0::DOUBLE - ay) / (by_ - ay) AS ty1 FROM segs))
 SELECT line_id, round(SUM(len * (hi - lo)), 4) AS len FROM c WHERE hi > lo GROUP BY 1""",
)
def clip_length(spark, d):
    """Length of each line inside a rectangle."""
    box = areas(spark).where("area = 1")
    out = spatial.clipped_lengths(lines(spark, d), box, 200.0, "line_id", "area")
    return out.groupBy("line_id").agg(F.round(F.sum("len"), 4).alias("len"))


@register("point_at_fraction", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT sid AS line_id, round((ax + bx) / 2, 6) AS mx, round((ay + by_) / 2, 6) AS my, round(ax + 0.25 * (bx - ax), 6) AS qx, 0.75::DOUBLE AS back FROM segs")
def point_at_fraction(spark, d):
    """Middle and quarter points, and the place of the three-quarter point found back on its line."""
    s = short_lines(spark, d)
    mid, quarter = geo.at_fraction("line", 0.5), geo.at_fraction("line", 0.25)
    back = geo.locate(geo.at_fraction("line", 0.75), "line")
    return s.select("line_id", F.round(mid["x"], 6).alias("mx"), F.round(mid["y"], 6).alias("my"), F.round(quarter["x"], 6).alias("qx"), F.round(back, 6).alias("back"))


@register("line_substring", f"WITH {POINTS_SQL}, {LINE_SQL} SELECT sid AS line_id, round(0.5 * sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)), 6) AS part, round(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)), 6) AS whole, CAST(floor(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) / 25) + 1 AS BIGINT) AS n_samples FROM segs")
def line_substring(spark, d):
    s = short_lines(spark, d)
    part = lambda a, b: F.round(geo.length(geo.substring("line", F.lit(a), F.lit(b))), 6)
    return s.select("line_id", part(0.2, 0.7).alias("part"), part(0.6, 0.6).alias("whole"), F.size(geo.sample("line", 25.0)).cast("long").alias("n_samples"))


@register("line_outside_discs", f"WITH {POINTS_SQL}, {LINE_SQL}, q AS (SELECT sid, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len, pow(bx - ax, 2) + pow(by_ - ay, 2) AS a, 2 * (ax * (bx - ax) + ay * (by_ - ay)) AS b, ax * ax + ay * ay - 6400 AS c FROM segs) SELECT sid AS line_id, round(len - CASE WHEN b * b - 4 * a * c > 0 THEN len * greatest(0, least(1, (-b + sqrt(b * b - 4 * a * c)) / (2 * a)) - greatest(0, (-b - sqrt(b * b - 4 * a * c)) / (2 * a))) ELSE 0 END, 4) AS len FROM q".replace("sqrt(b * b - 4 * a * c)", "sqrt(greatest(0, b * b - 4 * a * c))"))
def line_outside_discs(spark, d):
    """What is left of a line outside a disc of 80 round a crossing."""
    centre = F.array(geo.point(F.lit(0.0), F.lit(0.0)))
    return short_lines(spark, d).select("line_id", F.round(geo.outside_discs("line", centre, 80.0), 4).alias("len"))


@register("centroids", "SELECT * FROM (VALUES (1, -100.0::DOUBLE, -50.0::DOUBLE, -100.0::DOUBLE), (2, 100.0::DOUBLE, -50.0::DOUBLE, 100.0::DOUBLE), (3, 0.0::DOUBLE, 166.666667::DOUBLE, 0.0::DOUBLE), (4, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)) v(area, cx, cy, box_x)")
def centroids(spark, d):
    c, b = geo.centroid("rings"), geo.bbox_centre(geo.bbox(F.flatten("rings")))
    return areas(spark).select("area", (F.round(c["x"], 6) + 0.0).alias("cx"), (F.round(c["y"], 6) + 0.0).alias("cy"), F.round(b["x"], 6).alias("box_x"))


@register("hull_covers", "SELECT label, COUNT(*) AS n, TRUE AS all_covered FROM embeddings GROUP BY 1")
def hull_covers(spark, d):
    """A group's convex hull covers every point of the group."""
    p = points(spark, d)
    h = p.groupBy("label").agg(geo.hull(F.collect_set(F.struct(F.round("x", 1).alias("x"), F.round("y", 1).alias("y")))).alias("hull"))
    inside = geo.covers(F.col("hull"), F.struct(F.round("x", 1).alias("x"), F.round("y", 1).alias("y")))
    return p.join(h, "label").groupBy("label").agg(F.count("*").alias("n"), F.bool_and(inside).alias("all_covered"))


@register("projected_positions", "SELECT s_suppkey, round(-96 + (s_suppkey % 9) - 4, 6) AS lon, round(30 + s_suppkey % 7, 6) AS lat FROM supplier")
def projected_positions(spark, d):
    """Equal-area metres and back."""
    s = t(spark, d, "supplier").select("s_suppkey", (-96 + (F.col("s_suppkey") % 9) - 4).cast("double").alias("lon"), (30 + F.col("s_suppkey") % 7).cast("double").alias("lat"))
    s = s.withColumn("p", geo.albers("lon", "lat", "3083"))
    back = geo.inverse_albers("p.x", "p.y", "3083")
    return s.select("s_suppkey", F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


# --- networks --------------------------------------------------------------------------------------------------------

#: The network of orders and parts; an edge is cut where every line of it is a large one, most are.
NET_SQL = "ed AS MATERIALIZED (SELECT l_orderkey * 4294967296 + l_partkey AS edge_id, l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst, bool_and(l_quantity > 8) AS gone FROM lineitem GROUP BY 1, 2, 3)"


def network(spark, d):
    key = ((F.col("l_orderkey") * 4294967296 + F.col("l_partkey")).alias("edge_id"), (F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    edges = t(spark, d, "lineitem").groupBy(*key).agg(F.bool_and(F.col("l_quantity") > 8).alias("gone"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes, edges


def comp_sql(name: str, where: str = "TRUE") -> str:
    """Components by passing on the least label; one row per node is kept."""
    return f"""{name}_e AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed WHERE {where} UNION SELECT dst, src FROM ed WHERE {where}),
 {name}(node, comp) USING KEY (node) AS (SELECT * FROM (SELECT src, src FROM ed UNION SELECT dst, dst FROM ed)
  UNION (SELECT DISTINCT ON (p.node) p.node, n.comp FROM recurring.{name} p JOIN {name}_e e ON e.a = p.node JOIN {name} n ON n.node = e.b WHERE n.comp < p.comp ORDER BY p.node, n.comp))"""


@register("components", f"WITH RECURSIVE {NET_SQL}, {comp_sql('c')} SELECT node, comp FROM c")
def components(spark, d):
    return graph.labelled(*network(spark, d))


_CUT = "gone"
STRAND_SQL = f"""{NET_SQL}, {comp_sql('c0')}, {comp_sql('c1', f'NOT ({_CUT})')},
 m0 AS (SELECT comp FROM c0 GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1), b AS (SELECT c0.node, c0.comp = (SELECT comp FROM m0) AS was_main, c1.comp FROM c0 JOIN c1 USING (node)),
 m1 AS (SELECT comp FROM b WHERE was_main GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1), st AS (SELECT node, was_main, comp, was_main AND comp = (SELECT comp FROM m1) AS main_now, was_main AND comp <> (SELECT comp FROM m1) AS stranded FROM b)"""


@register("strand_after_cut", f"WITH RECURSIVE {STRAND_SQL} SELECT * FROM st")
def strand_after_cut(spark, d):
    nodes, edges = network(spark, d)
    return graph.stranded(nodes, edges, edges.where(_CUT).select("edge_id"))


EDGE_SQL_ = f"""{STRAND_SQL}, es AS (SELECT edge_id, u.comp AS cu, v.comp AS cv, u.stranded AS su, v.stranded AS sv, u.main_now AS mu, v.main_now AS mv, {_CUT} AS cut FROM ed JOIN st u ON u.node = src JOIN st v ON v.node = dst)"""


def _states(spark, d):
    nodes, edges = network(spark, d)
    cut = edges.where(_CUT).select("edge_id")
    state = graph.stranded(nodes, edges, cut)
    return state, graph.edge_state(edges, state, cut)


@register("edge_labels", f"WITH RECURSIVE {EDGE_SQL_} SELECT edge_id, CASE WHEN cut THEN -2 WHEN su AND sv THEN cu WHEN mu AND mv THEN -1 ELSE -3 END AS label FROM es")
def edge_labels(spark, d):
    return _states(spark, d)[1].select("edge_id", graph.edge_label().alias("label"))


@register(
    "group_stats",
    f"""WITH RECURSIVE {EDGE_SQL_}, x AS (SELECT cu AS comp, edge_id, mv AS m FROM es WHERE cut AND su UNION ALL SELECT cv, edge_id, mu FROM es WHERE cut AND sv),
 g AS (SELECT comp, COUNT(DISTINCT edge_id) AS n_cross, COUNT(DISTINCT CASE WHEN m THEN edge_id END) AS n_to_main FROM x GROUP BY 1), n AS (SELECT comp, COUNT(*) AS n_nodes FROM st WHERE stranded GROUP BY 1)
 SELECT comp, COALESCE(n_cross, 0) AS n_cross, COALESCE(n_to_main, 0) AS n_to_main, n_nodes, COALESCE(n_cross, 0) = 1 AS single_crossing FROM n LEFT JOIN g USING (comp)""",
)
def group_stats(spark, d):
    return graph.group_stats(*_states(spark, d))


@register("stranded_segments", f"WITH RECURSIVE {EDGE_SQL_} SELECT edge_id, cu AS comp FROM es WHERE su AND sv AND NOT cut")
def stranded_segments(spark, d):
    return _states(spark, d)[1].where("su and sv and not cut").select("edge_id", F.col("cu").alias("comp"))
