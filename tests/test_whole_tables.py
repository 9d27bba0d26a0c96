"""Queries over all labels against brute force."""

import math

import __spark_entry__ as entry
from terrafold.operators import reachability as rc
from terrafold.plans import places

SF = "/root/testdata/sf0.001"


def to_line(p, line):
    (ax, ay), (bx, by) = line
    t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return math.hypot(ax + t * (bx - ax) - p[0], ay + t * (by - ay) - p[1])


def test_exits_of_every_area(spark):
    s = [(r.label, [(p.x, p.y) for p in r.line]) for r in places.short_lines(spark, SF).collect()]
    want = {}
    for area in {k for k, _ in s}:
        main, samples = [q for k, q in s if k != area], []
        for line in (q for k, q in s if k == area):
            (ax, ay), (bx, by) = line
            n = int(math.dist(*line) // 25)
            samples += [(ax + k * 25 / math.dist(*line) * (bx - ax), ay + k * 25 / math.dist(*line) * (by - ay)) for k in range(n + 1)]
        want[area] = min(min(to_line(p, q) for q in main) for p in samples if math.hypot(*p) >= 80)
    got = {r.area: r.exits for r in entry.queries()["exit_candidates"](spark, SF).collect()}
    assert set(got) == set(want)
    for area, exits in got.items():
        assert 1 <= len(exits) <= 3 and exits[0].d <= want[area] + 1e-6
        assert all(math.hypot(a.x - b.x, a.y - b.y) > 300 for i, a in enumerate(exits) for b in exits[:i])


def test_exits_in_far_rings(spark):
    from pyspark.sql import functions as F

    lines = [(1, 1, [(0.0, 0.0), (100.0, 0.0)]), (2, 2, [(0.0, 900.0), (100.0, 900.0)]), (3, 3, [(0.0, -5000.0), (100.0, -5000.0)])]
    df = spark.createDataFrame(lines, "area int, line_id int, line array<struct<x:double,y:double>>")
    got = rc.exit_candidates(df, df, F.array().cast("array<struct<x:double,y:double>>")).collect()
    assert {r.area: [e.d for e in r.exits] for r in got} == {1: [900.0], 2: [900.0]}
