"""Joins by distance and containment as equi-joins on grid cells.

Spark plans a join on ``distance <= r`` alone as a nested loop over all pairs. Every join here first
gives both sides the cells of a square grid and joins on the cell, so that it is hashed, shuffled and
split like any other equi-join; the exact test follows inside the join's condition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geometry as geo
from terrafold.operators.tables import materialize


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def box_cells(xmin: Column, xmax: Column, ymin: Column, ymax: Column, size: float) -> Column:
    """All cells that a box meets."""
    xs, ys = F.sequence(cell(xmin, size), cell(xmax, size)), F.sequence(cell(ymin, size), cell(ymax, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def point_cells(x: Column, y: Column, size: float, reach: float = 0.0) -> Column:
    return box_cells(x - reach, x + reach, y - reach, y + reach, size)


def distance_join(a: DataFrame, b: DataFrame, r: float, ax: str = "x", ay: str = "y", bx: str = "x2", by: str = "y2") -> DataFrame:
    """Pairs of points within ``r``, with ``dist``. Side ``a`` is sent to every cell within reach, ``b`` to its own, so no pair comes twice."""
    cells_a = a.withColumn("_c", F.explode(point_cells(F.col(ax), F.col(ay), r, r)))
    cells_b = b.withColumn("_c", F.struct(cell(F.col(bx), r).alias("cx"), cell(F.col(by), r).alias("cy")))
    dist = F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))
    return cells_a.join(cells_b, "_c").drop("_c").withColumn("dist", dist).where(F.col("dist") <= r)


def nearest(a: DataFrame, b: DataFrame, r: float, a_id: str, b_id: str, ties: bool = False, k: int = 1, where: str = "true", **xy) -> DataFrame:
    """The nearest (``k`` nearest) points of ``b`` within ``r`` among the pairs ``where`` holds: by distance, then id; with ``ties`` all at the least distance."""
    near = distance_join(a, b, r, **xy).where(where)
    w = Window.partitionBy(a_id)
    rank = F.rank().over(w.orderBy("dist")) if ties else F.row_number().over(w.orderBy("dist", b_id))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_unbounded(a: DataFrame, b: DataFrame, first: float, a_id: str, b_id: str, where: str = "true", ax: str = "x", ay: str = "y", bx: str = "x2", by: str = "y2") -> DataFrame:
    """``(a_id, b_id, dist)``: the nearest point of ``b`` however far, among the pairs ``where`` holds; by distance, then id.

    Rings of doubling radius, each for the points that have none yet, until all are served or the ring spans both tables, which
    leaves out only points without coordinates or without any partner. A ring's pairs are reduced to the best per point before
    they are shuffled: a late ring has cells as wide as the data, but few points wait for it and each task sends one row for
    each. Each ring is written out, so that the plan stays that of one ring.
    """
    sides = (a.select(F.col(ax).alias("x"), F.col(ay).alias("y")), b.select(F.col(bx).alias("x"), F.col(by).alias("y")))
    box = sides[0].union(sides[1]).agg(*(f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    span = 0.0 if None in box else math.hypot(box["hix"] - box["lox"], box["hiy"] - box["loy"])
    out, left, r = None, a, first
    while True:
        near = distance_join(left, b, r, ax, ay, bx, by).where(where)
        best = near.groupBy(a_id).agg(F.min(F.struct("dist", b_id)).alias("_n")).select(a_id, f"_n.{b_id}", "_n.dist")
        found = materialize(best, "ring")
        out = found if out is None else out.unionByName(found)
        if r > span:
            return out
        left = materialize(left.join(found.select(a_id), a_id, "left_anti"), "left")
        if left.isEmpty():
            return out
        r *= 2


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", rings: str = "rings", predicate: str = "within") -> DataFrame:
    """Pairs of points and polygons under ``within``, ``intersects`` or ``touches``; a point may meet several."""
    box = geo.bbox(F.flatten(F.col(rings)))
    tiles = polygons.withColumn("_b", box).withColumn("_c", F.explode(box_cells(F.col("_b.xmin"), F.col("_b.xmax"), F.col("_b.ymin"), F.col("_b.ymax"), size))).drop("_b")
    own = points.withColumn("_c", F.struct(cell(F.col(x), size).alias("cx"), cell(F.col(y), size).alias("cy")))
    test = {"within": geo.within, "intersects": geo.intersects, "touches": geo.touches}[predicate]
    if predicate != "within":  # a point on a cell's edge may belong to a polygon that ends there
        own = points.withColumn("_c", F.explode(point_cells(F.col(x), F.col(y), size, geo.ON)))
    met = own.join(tiles, "_c").drop("_c").where(test(geo.point(x, y), F.col(rings)))
    return met if predicate == "within" else met.dropDuplicates([c for c, t in met.dtypes if not t.startswith("array")])


#: Rows of one side of a cell that a task pairs at a time; a cell with more becomes pairs of tiles.
TILE = 1024


def tiled_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, tile: int = TILE) -> DataFrame:
    """Equi-join on the cell ``_c``. Cells that only one side has go; crowded ones are split into pairs of tiles, so that one cell is many tasks' work."""
    count = lambda df, n: df.groupBy("_c").agg(F.ceil(F.count("*") / tile).alias(n))
    tiles = count(a, "_na").join(count(b, "_nb"), "_c")
    own = lambda k, n: F.pmod(F.xxhash64(k), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = a.join(tiles, "_c").withColumn("_i", own(a_id, "_na")).withColumn("_j", every("_nb")).drop("_na", "_nb")
    right = b.join(tiles, "_c").withColumn("_j", own(b_id, "_nb")).withColumn("_i", every("_na")).drop("_na", "_nb")
    return left.join(right, ["_c", "_i", "_j"]).drop("_i", "_j")


def piece_cells(a: Column, b: Column, r: float, size: float) -> Column:
    """The cells that may hold a point within ``r`` of the piece: column by column those beside its own stretch, not its whole box."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    low, high = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    room = r + geo.ON  # for the rounding of a stretch's ends

    def column(cx: Column) -> Column:
        at = lambda x: a["y"] + F.when(dx == 0, 0.0).otherwise(F.try_divide(x - a["x"], dx)) * dy
        y0, y1 = at(F.greatest(low, cx * size - room)), at(F.least(high, (cx + 1) * size + room))
        lo = F.when(dx == 0, F.least(a["y"], b["y"])).otherwise(F.least(y0, y1))
        hi = F.when(dx == 0, F.greatest(a["y"], b["y"])).otherwise(F.greatest(y0, y1))
        return F.transform(F.sequence(cell(lo - room, size), cell(hi + room, size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(low - room, size), cell(high + room, size)), column))


def dealt(pieces: DataFrame, by: str) -> DataFrame:
    """Pieces dealt over all tasks before cells are worked out: by a number of its own, else a table of few bytes but many cells becomes one task."""
    return pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def points_near_pieces(points: DataFrame, lines: DataFrame, r: float, point_id: str, line_id: str, x: str = "x", y: str = "y", line: str = "line", keep: tuple[str, ...] = (), line_keep: tuple[str, ...] = (), where: str = "true") -> DataFrame:
    """Points and pieces of lines within ``r``, with ``dist`` and the columns to keep, a row per piece; all rows of a point are in few tasks, so a sum by point is small before it moves."""
    parts = lines.select(line_id, *line_keep, F.explode(geo.pieces(F.col(line))).alias("_p"))
    parts = dealt(parts, "_p")
    parts = parts.withColumn("_c", F.explode(piece_cells(F.col("_p.a"), F.col("_p.b"), r, r)))
    own = points.select(point_id, x, y, *keep).withColumn("_c", F.struct(cell(F.col(x), r).alias("cx"), cell(F.col(y), r).alias("cy")))
    d = geo.point_piece(geo.point(x, y), F.col("_p.a"), F.col("_p.b"))
    return tiled_join(own, parts, point_id, line_id).where(where).withColumn("dist", d).where(F.col("dist") <= r)


def lines_near_points(points: DataFrame, lines: DataFrame, r: float, point_id: str, line_id: str, x: str = "x", y: str = "y", line: str = "line") -> DataFrame:
    """Pairs of points and lines within ``r``, with ``dist``: by the cells of the lines' pieces, so a long line doesn't fill its box."""
    near = points_near_pieces(points, lines, r, point_id, line_id, x, y, line)
    return near.groupBy(point_id, line_id).agg(F.min("dist").alias("dist"))


def pieces_near_pieces(one: DataFrame, two: DataFrame, r: float, one_id: str, two_id: str, line: str = "line", size: float | None = None, keep: tuple[str, ...] = (), keep_two: tuple[str, ...] = (), where: str = "true") -> DataFrame:
    """Pairs of pieces of lines within ``r``, with ``dist`` and the columns to keep. Pieces meet in every cell that both boxes touch, but a pair is tested in one alone,
    the cell of the least corner that the boxes share, and only if neither's line leaves the other farther than ``r`` to one side. ``size`` is that of the cells; if not given the mean extent of the pieces, ``r`` at least."""

    def parts(df: DataFrame, key: str, name: str, own: tuple[str, ...]) -> DataFrame:
        p = dealt(df.select(key, *own, F.explode(geo.pieces(F.col(line))).alias("_s")), "_s")
        a, b = F.col("_s.a"), F.col("_s.b")
        ends = {f"{name}{f}{c}": g(a[c], b[c]) for c in "xy" for f, g in (("0", F.least), ("1", F.greatest))}
        p = p.withColumns({f"{name}{e}{c}": F.col(f"_s.{e}")[c] for e in "ab" for c in "xy"} | ends)
        long = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        p = p.withColumns({f"{name}nx": F.coalesce(F.try_divide(a["y"] - b["y"], long), F.lit(0.0)), f"{name}ny": F.coalesce(F.try_divide(b["x"] - a["x"], long), F.lit(0.0))})
        return p.drop("_s")

    def beside(n: str, m: str) -> Column:
        """Whether the line through ``n`` leaves piece ``m`` wholly on one side, farther than ``r``."""
        s = [F.col(f"{n}nx") * (F.col(f"{m}{e}x") - F.col(f"{n}ax")) + F.col(f"{n}ny") * (F.col(f"{m}{e}y") - F.col(f"{n}ay")) for e in "ab"]
        room = F.lit(r * (1 + 1e-9) + 1e-6)
        return (F.least(*s) > room) | (F.greatest(*s) < -room)

    p, q = parts(one, one_id, "_p", keep), parts(two, two_id, "_q", keep_two)
    if size is None:
        extent = lambda df, n: df.select(F.greatest(F.col(f"{n}1x") - F.col(f"{n}0x"), F.col(f"{n}1y") - F.col(f"{n}0y")).alias("e"))
        mean = extent(p, "_p").union(extent(q, "_q")).agg(F.avg("e")).first()[0]
        size = max(r, mean if mean and math.isfinite(mean) else r)
    low = {c: F.col(f"_p0{c}") - r for c in "xy"}
    p = p.withColumn("_c", F.explode(box_cells(low["x"], F.col("_p1x") + r, low["y"], F.col("_p1y") + r, size)))
    q = q.withColumn("_c", F.explode(box_cells(F.col("_q0x"), F.col("_q1x"), F.col("_q0y"), F.col("_q1y"), size)))
    corner = {c: cell(F.greatest(low[c], F.col(f"_q0{c}")), size) == F.col(f"_c.c{c}") for c in "xy"}
    meet = [(low[c] <= F.col(f"_q1{c}")) & (F.col(f"_q0{c}") <= F.col(f"_p1{c}") + r) for c in "xy"]
    d = geo.piece_piece_udf(*(f"{n}{e}{c}" for n in ("_p", "_q") for e in "ab" for c in "xy"))
    both = tiled_join(p, q, one_id, two_id).where(corner["x"] & corner["y"] & meet[0] & meet[1]).where(where).where(~beside("_p", "_q") & ~beside("_q", "_p"))
    return both.withColumn("dist", d).where(F.col("dist") <= r).select(one_id, *keep, two_id, *keep_two, "dist")


def lines_near_lines(one: DataFrame, two: DataFrame, r: float, one_id: str, two_id: str, line: str = "line", size: float | None = None, keep: tuple[str, ...] = (), keep_two: tuple[str, ...] = (), where: str = "true") -> DataFrame:
    """Pairs of lines within ``r`` among those ``where`` holds, with ``dist``; see :func:`pieces_near_pieces`."""
    near = pieces_near_pieces(one, two, r, one_id, two_id, line, size, keep, keep_two, where)
    return near.groupBy(one_id, two_id).agg(F.min("dist").alias("dist"))


def clipped_lengths(lines: DataFrame, polygons: DataFrame, size: float, line_id: str, polygon_id: str, line: str = "line", rings: str = "rings") -> DataFrame:
    """Length of each line in each polygon that it runs through; a part on a shared boundary counts in both."""
    lb, pb = geo.bbox(F.col(line)), geo.bbox(F.flatten(F.col(rings)))
    cells = lambda df, b: df.withColumn("_b", b).withColumn("_c", F.explode(box_cells(F.col("_b.xmin"), F.col("_b.xmax"), F.col("_b.ymin"), F.col("_b.ymax"), size))).drop("_b")
    left = cells(lines.select(line_id, line), lb).select(line_id, "_c")
    right = cells(polygons.select(polygon_id, rings), pb).select(polygon_id, "_c")
    met = left.join(right, "_c").select(line_id, polygon_id).distinct()
    full = met.join(lines.select(line_id, line), line_id).join(polygons.select(polygon_id, rings), polygon_id)
    return full.select(line_id, polygon_id, geo.clipped_length(line, rings).alias("len")).where("len > 0")


def one_polygon_per_point(pairs: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """Each point's polygon with the lowest key."""
    w = Window.partitionBy(point_id).orderBy(polygon_id)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def default_size(extent: float, rows: int) -> float:
    """A cell size that leaves a few points in each cell."""
    return max(extent / max(1.0, math.sqrt(rows / 4)), 1e-9)


def located_edge(points: DataFrame, edges: DataFrame, seg: str = "seg_id", pos: str = "pos", tol: float = 1e-9) -> DataFrame:
    """Each point's sub-edge on its segment: the first that holds its place, else the segment's first."""
    both = points.join(edges.select(seg, "edge_id", "a0", "a1"), seg)
    inside = (F.col(pos) >= F.col("a0") - tol) & (F.col(pos) <= F.col("a1") + tol)
    keys = [c for c in points.columns]
    return both.groupBy(*keys).agg(F.coalesce(F.min(F.when(inside, F.col("edge_id"))), F.min("edge_id")).alias("edge_id"))
