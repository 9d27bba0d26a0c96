"""Functions and operators against worked cases, and against plain Python."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as geo
from terrafold.functions import roads, scoring, text
from terrafold.operators import graph, matcher, quality, relational, resample, spatial
from terrafold.sources import readers, sinks
from terrafold.streaming import windows

SF = "/root/testdata/sf0.001"


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("o, r, cap, want", [(8, 10, True, 0.2), (15, 10, True, 0.0), (0, 10, True, 1.0), (5, 0, True, None), (30, 10, False, -2.0), (None, 10, True, None), (5, None, True, None)])
def test_gap(spark, o, r, cap, want):
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in (o, r))], "o double, r double")
    got = df.select(scoring.gap("o", "r", cap).alias("v")).first()["v"]
    assert got == (None if want is None else pytest.approx(want))


def test_mean_defined_and_rounding(spark):
    df = spark.createDataFrame([(None, 0.2, 0.4), (None, None, None), (1.0, None, None)], "a double, b double, c double")
    got = [r.v for r in df.select(scoring.mean_defined("a", "b", "c").alias("v")).collect()]
    assert got[0] == pytest.approx(0.3) and got[1] is None and got[2] == 1.0
    ties = [0.5, 1.5, 2.5, -0.5, 3.5]
    df = spark.createDataFrame([(x,) for x in ties], "x double")
    assert [r.v for r in df.select(scoring.round_even("x", 0).alias("v")).collect()] == [float(round(x)) for x in ties]


def test_wilson_goldens(spark):
    low, high = scoring.wilson("k", "n")
    rows = spark.createDataFrame([(11, 20), (5, 19), (0, 0)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert [(round(r.a, 4), round(r.b, 4)) for r in rows[:2]] == [(0.3421, 0.7418), (0.1181, 0.4879)]
    assert rows[2].a is None


def test_kappa_golden(spark):
    m = [[4, 0, 0, 5], [0, 0, 1, 1], [0, 0, 7, 2], [1, 0, 6, 13]]
    n = sum(map(sum, m))
    agree = sum(m[i][i] for i in range(4)) / n
    chance = sum(sum(m[i]) * sum(r[i] for r in m) for i in range(4)) / n**2
    assert round(chance, 3) == 0.369
    assert round(one(spark, scoring.kappa(F.col("a"), F.col("c")), a=agree, c=chance), 3) == 0.366


def test_beta_and_poisson_ratio():
    assert scoring.beta_cdf(0.5, 2, 2) == pytest.approx(0.5)
    assert scoring.beta_cdf(0.3, 1, 1) == pytest.approx(0.3)
    assert scoring.beta_quantile(0.975, 1, 1) == pytest.approx(0.975)
    assert scoring.beta_cdf(0.2, 3, 5) == pytest.approx(sum(math.comb(7, k) * 0.2**k * 0.8 ** (7 - k) for k in range(3, 8)))
    ratio, low, high = scoring.poisson_ratio_interval(10, 100.0, 10, 100.0)
    assert ratio == 1 and low < 1 < high and low * high == pytest.approx(1)
    assert scoring.standardised([0.1, 0.3], [1, 3]) == pytest.approx(0.25)


# --- text ------------------------------------------------------------------------------------------------------------


def test_aliases_and_ids(spark):
    rows = spark.createDataFrame([("CR 215 (PURGATORY RD)", "Purgatory Road", "CR 215|FM 1", "A_name_verified"), ("Elm / Oak & Ash", None, None, "none"), ("UNNAMED", "X Road", None, "C")], "road string, s string, r string, tier string")
    got = [[(a.name, a.source) for a in r.a] for r in rows.select(text.aliases("road", "s", "r", "tier").alias("a")).collect()]
    assert ("PURGATORY RD", "inventory") in got[0] and ("FM 1", "segment") in got[0]
    assert {"Elm", "Oak", "Ash"} <= {a for a, _ in got[1]} and got[2] == []
    assert one(spark, text.pad_id(F.col("x")), x="48001") == "00000048001" and one(spark, text.pad_id(F.col("x")), x="123456789012") == "123456789012"


def test_excerpt_is_centred(spark):
    words = [f"w{i}" for i in range(60)]
    s = " ".join(words)
    got = one(spark, text.excerpt(F.col("s"), F.col("o"), 25), s=s, o=s.index("w40"))
    assert got.startswith("...w28 ") and got.endswith("w52...") and one(spark, text.excerpt(F.col("s")), s="  ") == ""


@pytest.mark.parametrize("s, want", [("County Roads 258 and 268 flooded", [("CR", "258"), ("CR", "268")]), ("FM 0012a and Highway 7", [("FMRM", "12A"), ("HWY", "7")]), ("on I-35 and US 290", [("US", "290"), ("IH", "35")]), ("roads 5 inches", [])])
def test_routes(s, want):
    assert [(r["cls"], r["key"]) for r in roads.roads(s) if r["kind"] == "route"] == want


def test_named_roads_and_references():
    got = roads.roads("A car stalled on Old Mill Road east of Beck Lane.")
    assert [(r["key"], r["ref"]) for r in got] == [("OLD MILL RD", False), ("BECK LN", True)]
    assert roads.roads("at the Low Water Crossing Road") == [] and roads.roads(None) == []
    assert roads.roads("swept off Mill Road")[0]["ref"] is False and roads.roads("crossing off Mill Road")[0]["ref"] is True


def test_streams():
    assert roads.streams("near Cibolo Creek and Dry Comal Creek") == ["CIBOLO CREEK", "DRY COMAL CREEK"]
    assert roads.streams("on Walnut Creek Road") == []
    assert roads.compare_streams("COTTONWOOD CREEK SOUTH", ["COTTONWOOD CREEK"]) == "same"
    assert roads.compare_streams("HOG CREEK, TRIB", ["HOG CREEK"]) == "related"
    assert roads.compare_streams("MOUNTIAN CREEK", ["MOUNTAIN CREEK"]) == "spelling variant"
    assert roads.compare_streams("BEAR CREEK", ["ELM CREEK"]) == "different" and roads.compare_streams(None, ["ELM CREEK"]) == "unknown"
    assert roads.inventory_key("RM 0012") == "route:FMRM:12" and roads.inventory_key("N Elm Street") == "named:ELM ST" and roads.inventory_key("ELM") is None


# --- geometry --------------------------------------------------------------------------------------------------------


def line(*pts):
    return F.array(*(geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in pts))


def test_lines(spark):
    l = line((0, 0), (10, 0), (10, 10))
    assert one(spark, geo.length(l)) == 20
    assert one(spark, geo.at_fraction(l, 0.75)).asDict() == {"x": 10.0, "y": 5.0}
    assert one(spark, geo.locate(geo.point(F.lit(12.0), F.lit(5.0)), l)) == 0.75
    assert one(spark, geo.length(geo.substring(l, F.lit(0.25), F.lit(0.75)))) == 10
    assert one(spark, geo.line_line(l, line((5, -5), (5, 5)))) == 0
    assert one(spark, geo.point_line(geo.point(F.lit(3.0), F.lit(4.0)), l)) == 4
    assert [(p.x, p.y) for p in one(spark, geo.sample(l, 10.0))] == [(0, 0), (10, 0), (10, 10)]


def holed():
    return F.array(line((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), line((4, 4), (4, 6), (6, 6), (6, 4), (4, 4)))


def test_polygons_with_a_hole(spark):
    assert one(spark, geo.clipped_length(line((-5, 5), (15, 5)), holed())) == pytest.approx(8)
    assert one(spark, geo.clipped_length(line((0, 0), (10, 0)), holed())) == pytest.approx(10)
    p = lambda x, y: geo.point(F.lit(float(x)), F.lit(float(y)))
    assert one(spark, geo.within(p(5, 5), holed())) is False and one(spark, geo.within(p(1, 1), holed())) is True
    assert one(spark, geo.within(p(0, 5), holed())) is False and one(spark, geo.intersects(p(0, 5), holed())) is True
    c = one(spark, geo.centroid(holed()))
    assert (c.x, c.y) == (5, 5)


def test_hull_against_plain(spark):
    r = random.Random(1)
    for n in (3, 10, 60):
        pts = [(r.randrange(20), r.randrange(20)) for _ in range(n)]
        got = one(spark, geo.hull(line(*pts)))
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

        def chain(ps):
            out = []
            for p in ps:
                while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        u = sorted(set(pts))
        want = chain(u) + chain(u[::-1])
        assert got is None if len(want) < 3 else [(p.x, p.y) for p in got[:-1]] == want


def test_projections(spark):
    at_origin = one(spark, geo.albers(F.lit(-100.0), F.lit(18.0), "3083"))
    assert (at_origin.x, at_origin.y) == pytest.approx((1_500_000, 6_000_000))
    # the worked example of the ellipsoidal formulas: Clarke's figure gives other metres, so only its own inverse is held to
    p = geo.albers(F.lit(-97.7), F.lit(30.3), "5070")
    back = one(spark, geo.inverse_albers(p["x"], p["y"], "5070"))
    assert (back.lon, back.lat) == pytest.approx((-97.7, 30.3), abs=1e-9)
    assert one(spark, geo.web_mercator(F.lit(180.0), F.lit(0.0))).x == pytest.approx(20037508.342789244)


def test_wkb(spark):
    poly = struct.pack("<BII", 1, 3, 1) + struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    multi = struct.pack("<BII", 1, 6, 2) + poly + poly
    pt = struct.pack(">BI2d", 0, 1, 3, 4)
    df = spark.createDataFrame([(bytearray(x),) for x in (poly, multi, pt)] + [(None,)], "w binary")
    got = [r.v for r in df.select(readers.wkb_rings("w").alias("v")).collect()]
    assert len(got[0]) == 1 and len(got[1]) == 2 and (got[2][0][0].x, got[2][0][0].y) == (3, 4) and got[3] is None


def test_spatial_joins_equal_brute_force(spark):
    r = random.Random(5)
    pts = [(i, r.uniform(-100, 100), r.uniform(-100, 100)) for i in range(150)] + [(900, 0.0, 0.0), (901, 0.0, 0.0), (902, 30.0, 0.0)]
    a = spark.createDataFrame(pts, "id long, x double, y double")
    b = a.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    got = {(x.id, x.id2) for x in spatial.distance_join(a, b, 30.0).collect()}
    assert got == {(i, j) for i, x, y in pts for j, z, w in pts if math.hypot(x - z, y - w) <= 30}
    far = spark.createDataFrame([(1, 5e4, 5e4)], "id long, x double, y double")
    near = spatial.nearest_unbounded(far, b, 10.0, "id", "id2").collect()
    assert near[0].id2 == min(pts, key=lambda p: (math.hypot(p[1] - 5e4, p[2] - 5e4), p[0]))[0]


# --- relations -------------------------------------------------------------------------------------------------------


def test_guarded_join_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="right repeats k=1"):
        relational.guarded_join(a, b, "k").collect()
    assert relational.guarded_join(b, a, "k").count() == 2


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, 5, None), (None, 3, 9, "z")], "k int, o int, v int, w string")
    assert [tuple(r) for r in relational.first_non_null(df, "k", ["o"], ["v", "w"]).collect()] == [(1, 5, "a")]
    x = spark.createDataFrame([(None, 1)], "k int, a int")
    assert relational.null_safe_join(x, spark.createDataFrame([(None, 2)], "k int, b int"), ["k"]).count() == 1


def test_first_component_states(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 10, 11)], "edge_id long, src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 10, 11, 50)], "node long")
    cut = spark.createDataFrame([(3,)], "edge_id long")
    state = graph.stranded(nodes, edges, cut)
    got = {r.node: (r.was_main, r.main_now, r.stranded) for r in state.collect()}
    assert got[4] == (True, False, True) and got[1] == (True, True, False) and got[50] == (False, False, False)
    stats = graph.group_stats(state, graph.edge_state(edges, state, cut)).collect()
    assert [tuple(r) for r in stats] == [(4, 1, 1, 1, True)]


def test_resampling(spark):
    units = spark.createDataFrame([(float(i), 2.0, i % 2 == 0) for i in range(40)], "v double, n double, g boolean")
    got = resample.interval(resample.ratio_bootstrap(units, "v", "n", 1000), above=0.0).first()
    assert got.low < 19.5 / 2 < got.high and got.share_above == 1
    p = resample.interval(resample.ratio_bootstrap(units, "v", "n", 300, most_units=0)).first()
    assert abs(p.low - got.low) < 1.5 and abs(p.high - got.high) < 1.5
    same = resample.ratio_bootstrap(units, "v", "n", 20)
    assert same.orderBy("draw").collect() == same.orderBy("draw").collect()
    assert resample.permutation_p(units, "v", "g", 500).first().p > 0.05
    odd = units.withColumn("v", F.when(F.col("g"), F.col("v") + 100).otherwise(F.col("v")))
    assert resample.permutation_p(odd, "v", "g", 500).first().p == pytest.approx(1 / 501)


# --- reports ---------------------------------------------------------------------------------------------------------


def test_matcher(spark):
    events = spark.createDataFrame(
        [
            (1, "A", "A car was swept off Mill Creek Road at the low water crossing of Bear Creek.", "", 100.0, 0.0, None, None, True, 0),
            (2, "A", "Heavy rain fell.", "", 0.0, 0.0, None, None, True, 0),
            (3, "A", "Water over the road at the crossing.", "", 100.0, 50.0, None, None, True, 0),
            (4, "A", "", "A motorist stalled on Elm Street.", None, None, None, None, False, 1),
            (5, "B", "A car drove into water on Mill Creek Road.", "", None, None, None, None, False, 0),
        ],
        "event_id long, county string, event_text string, episode_text string, begin_x double, begin_y double, end_x double, end_y double, coords_ok boolean, vehicle_deaths int",
    )
    crossings = spark.createDataFrame(
        [("x1", "A", "MILL CREEK RD", None, None, "C", "BEAR CREEK", 120.0, 10.0), ("x2", "A", "ELM ST", None, None, "C", None, 9000.0, 9000.0), ("x3", "A", "ELM ST", None, None, "C", None, 9500.0, 9000.0)],
        "crossing_id string, county string, road string, seg_name string, seg_refs string, tier string, stream string, x double, y double",
    )
    got = {(r.event_id, r.crossing_id): r for r in matcher.match(events, crossings).collect()}
    best = got[1, "x1"]
    assert (best.match_class, best.grade, best.listed) == ("confirmed", "A", True) and best.stream_agreement == "same"
    assert got[2, "x1"].listed is False and "coordinates only" in got[2, "x1"].why_not
    assert got[3, "x1"].listed is True and got[3, "x1"].match_class == "ambiguous"
    assert "none singled out" in got[4, "x2"].reasons and not any(k[0] == 5 for k in got)


# --- files, checks, streams ------------------------------------------------------------------------------------------


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5), (1, 1 / 3)], "k int, v double")
    sinks.write_csv_fixed(df, str(tmp_path / "c"), order=["k"], one_file=True)
    part = next((tmp_path / "c").glob("part-*"))
    assert part.read_bytes() == b"k,v\n1,0.333333\n2,0.500000\n"
    assert json.loads(sinks.to_json_bag(df.agg(F.sum("k").alias("s")))) == {"s": 3}
    assert sinks.fixed_width([{"a": "x", "n": 5}, {"a": "long", "n": 12}], ["a", "n"]) == "a      n\nx      5\nlong  12\n"
    assert sinks.fill("{{A}} of {{B}}", {"A": 1, "B": 2}) == "1 of 2"
    with pytest.raises(KeyError):
        sinks.fill("{{A}}", {})


def test_readers(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "roads.csv").write_text("a,b\n1,\n,x\n")
    assert readers.resolve(spark, str(tmp_path), "r1", "roads.csv").endswith("/r1/roads.csv")
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, str(tmp_path), "r1", "none.csv")
    rows = readers.read_csv(spark, str(tmp_path / "r1" / "roads.csv"), "a string, b string").collect()
    assert [tuple(r) for r in rows] == [("1", None), (None, "x")]


def test_quality(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="step 4 writes it"):
        quality.need(df, ["id", "x"], "counts", "step 4")
    with pytest.raises(AssertionError):
        quality.assert_same(df, spark.range(4), "counts")
    quality.assert_same(df, spark.range(3), "counts")


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    got = windows.run_to_end(windows.windowed(stream, "1 hour", late="10 minutes"), "hourly")
    want = windows.windowed(src, "1 hour")
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_range_join_is_hashed(spark):
    a = spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    b = a.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    plan = spatial.distance_join(a, b, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_independent_reachability():
    import numpy as np
    import pandas as pd

    from terrafold.operators import reachability as rc

    cross = rc.node_lines(np.array([[0, 0, 10, 0], [5, -5, 5, 5.0]]))
    assert sorted(map(tuple, cross)) == [(0, 0, 5, 0), (5, -5, 5, 0), (5, 0, 5, 5), (5, 0, 10, 0)]
    main = [("line", 0.0, 0.0, 1000.0, 0.0), ("line", 500.0, 0.0, 500.0, -400.0)]
    homes = [("building", 500.0, -300.0 - k, None, None) for k in range(5)]
    cut = [("crossing", 500.0, -100.0, None, None)]
    frame = lambda rows: pd.DataFrame(rows, columns=["kind", "x0", "y0", "x1", "y1"])
    whole = main[:1] + [("line", 500.0, 0.0, 500.0, -90.0), ("line", 500.0, -90.0, 500.0, -110.0), ("line", 500.0, -110.0, 500.0, -400.0)]
    assert rc.reachable_share(1, frame(whole + homes + [("crossing", 500.0, -100.0, None, None)])) == (1, "agrees_isolated", 0.0, 1)
    around = whole + [("line", 500.0, -400.0, 1000.0, 0.0)]
    assert rc.reachable_share(1, frame(around + homes + cut))[1] == "has_other_way"
    assert rc.reachable_share(1, frame(whole + cut))[1:3] == ("mixed", None)
    assert rc.reachable_share(1, frame(homes))[1] == "no_lines"
    assert rc.reachable_share(1, frame(main + [("crossing", 9e4, 9e4, None, None)]))[1] == "crossing_not_on_lines"
