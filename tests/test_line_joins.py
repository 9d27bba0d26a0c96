"""Joins of lines: every near pair is met, once, and long pieces don't fill their boxes."""

import random

from pyspark.sql import functions as F

from terrafold.functions import geometry as geo
from terrafold.operators import spatial

LINE = "id long, line array<struct<x:double,y:double>>"


def pieces(n, seed, far=200.0):
    r = random.Random(seed)
    at = lambda: (r.uniform(-far, far), r.uniform(-far, far))
    own = [[at(), at()] for _ in range(n - 3)]
    return [*enumerate(own), (n - 3, [(5.0, 5.0), (5.0, 5.0)]), (n - 2, [(0.0, -300.0), (0.0, 300.0)]), (n - 1, [(-300.0, 20.0), (300.0, 20.0)])]


def test_pairs_of_pieces_are_tested_once_in_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial.tiled_join, "__defaults__", (7,))
    a, b = spark.createDataFrame(pieces(60, 1), LINE), spark.createDataFrame(pieces(50, 2), LINE)
    one, two = a.withColumnRenamed("id", "one"), b.withColumnRenamed("id", "two")
    d = geo.piece_piece(F.col("p")[0], F.col("p")[1], F.col("q")[0], F.col("q")[1])
    every = one.withColumnRenamed("line", "p").crossJoin(two.withColumnRenamed("line", "q")).withColumn("d", d).where("d <= 12")
    want = {(x.one, x.two): round(x.d, 9) for x in every.collect()}
    got = spatial.pieces_near_pieces(one, two, 12.0, "one", "two").collect()
    assert len(got) == len(want) > 500
    assert {(x.one, x.two): round(x.dist, 9) for x in got} == want


def test_a_long_piece_takes_the_cells_beside_it(spark):
    lines = spark.createDataFrame(pieces(80, 3), LINE)
    r = random.Random(4)
    points = spark.createDataFrame([(i, r.uniform(-250, 250), r.uniform(-250, 250)) for i in range(300)], "pt long, x double, y double")
    d = geo.point_piece(F.struct("x", "y"), F.col("line")[0], F.col("line")[1])
    want = {(x.pt, x.id) for x in points.crossJoin(lines).where(d <= 10).collect()}
    near = spatial.points_near_pieces(points, lines, 10.0, "pt", "id").select("pt", "id").collect()
    assert len(near) == len(want) and {(x.pt, x.id) for x in near} == want
    diagonal = spark.createDataFrame([(0, [(0.0, 0.0), (1000.0, 1000.0)])], LINE)
    assert diagonal.select(F.size(spatial.piece_cells(F.col("line")[0], F.col("line")[1], 10.0, 10.0)).alias("n")).first().n < 800  # its box has over 10,000


def test_pieces_are_dealt_before_their_cells_are_made(spark):
    lines = spark.createDataFrame(pieces(20, 5), LINE).coalesce(1)
    points = spark.createDataFrame([(0, 0.0, 0.0)], "pt long, x double, y double")
    near = spatial.points_near_pieces(points, lines, 10.0, "pt", "id")
    both = spatial.pieces_near_pieces(lines.withColumnRenamed("id", "one"), lines.withColumnRenamed("id", "two"), 10.0, "one", "two", size=50.0)
    for df, key in ((near, "RepartitionByExpression [_p"), (both, "RepartitionByExpression [_s")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert key in plan and plan.index(key) > plan.index("Generate explode")


def test_pairs_of_single_pieces_are_not_summed_up(spark):
    import __spark_entry__ as entry

    df = entry.queries()["line_line_distance_all"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]


def test_dense_samples_begin_with_a_small_ring(spark, monkeypatch):
    from terrafold.operators import reachability as rc

    rings, near = [], spatial.points_near_pieces
    monkeypatch.setattr(spatial, "points_near_pieces", lambda p, q, r, *a, **b: rings.append(r) or near(p, q, r, *a, **b))
    rows = [(k % 2, k, line) for k, line in pieces(80, 6) if k < 77]
    df = spark.createDataFrame(rows, "area int, line_id long, line array<struct<x:double,y:double>>")
    got = {x.area: [round(e.d, 9) for e in x.exits] for x in rc.exit_candidates(df, df, F.array().cast("array<struct<x:double,y:double>>"), step=60.0, apart=50.0).collect()}
    assert rings[0] < 60 and rings == sorted(rings) and rings[-1] <= 1500
    pts = df.select("area", F.explode(geo.sample("line", 60.0)).alias("p"))
    d = geo.point_piece(F.col("p"), F.col("q")[0], F.col("q")[1])
    best = pts.join(df.select(F.col("area").alias("of"), F.col("line").alias("q")), F.expr("of <> area")).groupBy("area", "p").agg(F.min(d).alias("d"))
    for area in (0, 1):
        assert got[area][0] == round(best.where(f"area = {area}").agg(F.min("d")).first()[0], 9)
        assert len(got[area]) == 3
