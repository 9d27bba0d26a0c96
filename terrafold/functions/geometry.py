"""Planar geometry as Column expressions. A line is ``array<struct<x, y>>``; a polygon an array of closed rings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.scoring import as_col

ZERO = 0.0
#: Rounding room of "on the line".
ON = 1e-9


def point(x, y) -> Column:
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def pieces(line: Column) -> Column:
    """Consecutive point pairs ``array<struct<a, b>>``."""
    n = F.greatest(F.lit(0), F.size(line) - 1)
    return F.arrays_zip(F.slice(line, F.lit(1), n).alias("a"), F.slice(line, F.lit(2), n).alias("b"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(ZERO), lambda s, v: s + v)


def length(line: Column | str) -> Column:
    return total(F.transform(pieces(as_col(line)), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])))


def project(p: Column, a: Column, b: Column) -> Column:
    """Place of the nearest point of a piece, 0 at ``a`` to 1 at ``b``."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy)
    return F.greatest(F.lit(ZERO), F.least(F.lit(1.0), F.coalesce(t, F.lit(ZERO))))


def point_piece(p: Column, a: Column, b: Column) -> Column:
    t = project(p, a, b)
    return F.hypot(p["x"] - a["x"] - t * (b["x"] - a["x"]), p["y"] - a["y"] - t * (b["y"] - a["y"]))


def point_line(p: Column, line: Column | str) -> Column:
    return F.array_min(F.transform(pieces(as_col(line)), lambda s: point_piece(p, s["a"], s["b"])))


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def pieces_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two pieces cross in their insides; touching ends have distance 0 anyway."""
    return (cross(a, b, c) * cross(a, b, d) < 0) & (cross(c, d, a) * cross(c, d, b) < 0)


def piece_piece(a: Column, b: Column, c: Column, d: Column) -> Column:
    ends = F.least(point_piece(a, c, d), point_piece(b, c, d), point_piece(c, a, b), point_piece(d, a, b))
    return F.when(pieces_cross(a, b, c, d), ZERO).otherwise(ends)


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _point_piece(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    square = (d * d).sum(0)
    t = np.clip(np.divide(((p - a) * d).sum(0), square, out=np.zeros_like(square), where=square != 0), 0, 1)
    return np.hypot(*(p - a - t * d))


@F.pandas_udf(T.DoubleType())
def piece_piece_udf(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
    """:func:`piece_piece` for many pairs: as one expression it is too long a method for the JVM to compile."""
    a, b, c, d = (np.array(p, dtype=np.float64) for p in ((ax, ay), (bx, by), (cx, cy), (dx, dy)))
    crossing = (_cross(a, b, c) * _cross(a, b, d) < 0) & (_cross(c, d, a) * _cross(c, d, b) < 0)
    ends = np.minimum(np.minimum(_point_piece(a, c, d), _point_piece(b, c, d)), np.minimum(_point_piece(c, a, b), _point_piece(d, a, b)))
    return pd.Series(np.where(crossing, 0.0, ends))


def line_line(one: Column | str, two: Column | str) -> Column:
    two_ = pieces(as_col(two))
    return F.array_min(F.flatten(F.transform(pieces(as_col(one)), lambda p: F.transform(two_, lambda q: piece_piece(p["a"], p["b"], q["a"], q["b"])))))


def ring_pieces(rings: Column | str) -> Column:
    return F.flatten(F.transform(as_col(rings), pieces))


def on_boundary(p: Column, rings: Column | str) -> Column:
    return F.exists(ring_pieces(rings), lambda s: point_piece(p, s["a"], s["b"]) <= ON)


def ray_inside(p: Column, rings: Column | str) -> Column:
    """Parity of crossings over all rings, so holes are outside."""

    def hit(s: Column) -> Column:
        a, b = s["a"], s["b"]
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        x = a["x"] + F.try_divide((p["y"] - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return straddles & (p["x"] < x)

    return F.size(F.filter(ring_pieces(rings), hit)) % 2 == 1


def within(p: Column, rings: Column | str) -> Column:
    """Inside, not on the boundary."""
    return ray_inside(p, rings) & ~on_boundary(p, rings)


def intersects(p: Column, rings: Column | str) -> Column:
    """Inside or on the boundary."""
    return on_boundary(p, rings) | ray_inside(p, rings)


def touches(p: Column, rings: Column | str) -> Column:
    return on_boundary(p, rings)


def point_polygon(p: Column, rings: Column | str) -> Column:
    """Distance of a point to a polygon, 0 inside or on its boundary."""
    nearest = F.array_min(F.transform(ring_pieces(rings), lambda s: point_piece(p, s["a"], s["b"])))
    return F.when(ray_inside(p, rings), F.lit(0.0)).otherwise(nearest)


def ring_area(ring: Column) -> Column:
    return total(F.transform(pieces(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def centroid(rings: Column | str) -> Column:
    """Area centroid; rings that run the other way round than the first are holes."""
    s = ring_pieces(rings)
    w = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    area = total(F.transform(s, w)) / 2
    cx = total(F.transform(s, lambda p: (p["a"]["x"] + p["b"]["x"]) * w(p)))
    cy = total(F.transform(s, lambda p: (p["a"]["y"] + p["b"]["y"]) * w(p)))
    return F.struct(F.try_divide(cx, 6 * area).alias("x"), F.try_divide(cy, 6 * area).alias("y"))


def bbox(points: Column | str) -> Column:
    c = as_col(points)
    xs, ys = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))


def bbox_centre(box: Column | str) -> Column:
    b = as_col(box)
    return point((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2)


def clipped_length(line: Column | str, rings: Column | str) -> Column:
    """Length of a line inside a polygon, its boundary included.

    Each piece is cut where it meets a ring; a part counts where its middle is inside.
    """
    ring = ring_pieces(rings)

    def parts(s: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]

        def meets(r: Column) -> Column:
            ex, ey = r["b"]["x"] - r["a"]["x"], r["b"]["y"] - r["a"]["y"]
            det = dx * ey - dy * ex
            qx, qy = r["a"]["x"] - a["x"], r["a"]["y"] - a["y"]
            t, u = F.try_divide(qx * ey - qy * ex, det), F.try_divide(qx * dy - qy * dx, det)
            along = F.array(project(r["a"], a, b), project(r["b"], a, b))
            flat = F.abs(qx * dy - qy * dx) <= ON  # on one line: the ring's ends, as places on the piece
            crossing = F.array(t)
            return F.when(det == 0, F.when(flat, along)).when((t > 0) & (t < 1) & (u >= -ON) & (u <= 1 + ON), crossing)

        cuts = F.flatten(F.filter(F.transform(ring, meets), lambda x: x.isNotNull()))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(ZERO), F.lit(1.0)), cuts)))
        n = F.size(cuts) - 1
        spans = F.arrays_zip(F.slice(cuts, F.lit(1), n).alias("f"), F.slice(cuts, F.lit(2), n).alias("t"))

        def inside(z: Column) -> Column:
            m = (z["f"] + z["t"]) / 2
            return intersects(F.struct((a["x"] + m * dx).alias("x"), (a["y"] + m * dy).alias("y")), rings)

        return total(F.transform(F.filter(spans, inside), lambda z: z["t"] - z["f"])) * F.hypot(dx, dy)

    return total(F.transform(pieces(as_col(line)), parts))


def measures(line: Column) -> Column:
    """Pieces with the length before them, ``array<struct<a, b, before, len>>``."""
    with_len = F.transform(pieces(line), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]).alias("len")))
    before = lambda i: total(F.transform(F.slice(with_len, F.lit(1), i), lambda s: s["len"]))
    return F.transform(with_len, lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), before(i).alias("before"), s["len"].alias("len")))


def at_fraction(line: Column | str, fraction: Column | float) -> Column:
    """Point at a fraction of the length."""
    line = as_col(line)
    f = F.lit(fraction) if isinstance(fraction, float) else fraction
    target = length(line) * f
    seg = F.get(F.filter(measures(line), lambda s: s["before"] + s["len"] >= target - ON), F.lit(0))
    t = F.least(F.lit(1.0), F.coalesce(F.try_divide(target - seg["before"], seg["len"]), F.lit(ZERO)))
    return F.struct((seg["a"]["x"] + t * (seg["b"]["x"] - seg["a"]["x"])).alias("x"), (seg["a"]["y"] + t * (seg["b"]["y"] - seg["a"]["y"])).alias("y"))


def locate(p: Column, line: Column | str) -> Column:
    """Fraction of the length at the line's point that is nearest to ``p``; the first of equals."""
    line = as_col(line)
    near = F.transform(measures(line), lambda s: F.struct(point_piece(p, s["a"], s["b"]).alias("d"), (s["before"] + project(p, s["a"], s["b"]) * s["len"]).alias("m")))
    return F.try_divide(F.array_min(near)["m"], length(line))


def substring(line: Column | str, a0: Column, a1: Column) -> Column:
    """The line between two fractions; the whole line where they don't span any of it."""
    line = as_col(line)
    whole = length(line)
    inner = F.filter(measures(line), lambda s: (s["before"] > a0 * whole + ON) & (s["before"] < a1 * whole - ON))
    part = F.concat(F.array(at_fraction(line, a0)), F.transform(inner, lambda s: s["a"]), F.array(at_fraction(line, a1)))
    return F.when(a1 > a0, part).otherwise(line)


def sample(line: Column | str, step: float) -> Column:
    """Points every ``step`` along a line, from its start."""
    line = as_col(line)
    n = F.floor(length(line) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: at_fraction(line, F.coalesce(F.try_divide(i * F.lit(step), length(line)), F.lit(ZERO))))


def outside_discs(line: Column | str, centres: Column, radius: float) -> Column:
    """Length of a line outside discs: each piece is cut where it enters and leaves a disc."""
    line = as_col(line)

    def kept(s: Column) -> Column:
        a, dx, dy = s["a"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        qa = dx * dx + dy * dy

        def meets(c: Column) -> Column:
            fx, fy = a["x"] - c["x"], a["y"] - c["y"]
            qb, qc = 2 * (fx * dx + fy * dy), fx * fx + fy * fy - radius * radius
            root = F.sqrt(F.greatest(F.lit(ZERO), qb * qb - 4 * qa * qc))
            return F.when(qb * qb - 4 * qa * qc > 0, F.array(F.try_divide(-qb - root, 2 * qa), F.try_divide(-qb + root, 2 * qa)))

        cuts = F.filter(F.flatten(F.filter(F.transform(centres, meets), lambda x: x.isNotNull())), lambda t: (t > 0) & (t < 1))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(ZERO), F.lit(1.0)), cuts)))
        n = F.size(cuts) - 1
        spans = F.arrays_zip(F.slice(cuts, F.lit(1), n).alias("f"), F.slice(cuts, F.lit(2), n).alias("t"))

        def clear(z: Column) -> Column:
            m = (z["f"] + z["t"]) / 2
            return ~F.exists(centres, lambda c: F.hypot(a["x"] + m * dx - c["x"], a["y"] + m * dy - c["y"]) < radius)

        return total(F.transform(F.filter(spans, clear), lambda z: z["t"] - z["f"])) * F.sqrt(qa)

    return total(F.transform(pieces(line), kept))


def hull(points: Column | str) -> Column:
    """Convex hull of a point array, counter-clockwise and closed; null under three distinct corners.

    A point is a corner if some other one has all points on one side; corners are put in order by angle.
    """
    pts = F.array_sort(F.array_distinct(as_col(points)))

    def chain(ordered: Column) -> Column:
        def push(acc: Column, p: Column) -> Column:
            def drop(a: Column, _: Column) -> Column:
                n = F.size(a)
                bad = (n >= 2) & (cross(F.get(a, n - 2), F.get(a, n - 1), p) <= 0)
                return F.when(bad, F.slice(a, F.lit(1), n - 1)).otherwise(a)

            shrunk = F.aggregate(F.sequence(F.lit(0), F.size(acc)), acc, drop)
            return F.concat(shrunk, F.array(p))

        return F.aggregate(ordered, F.slice(ordered, F.lit(1), F.lit(0)), push)

    low, high = chain(pts), chain(F.reverse(pts))
    ring = F.concat(F.slice(low, F.lit(1), F.size(low) - 1), high)
    return F.when((F.size(pts) >= 3) & (F.size(ring) >= 4), ring)


def covers(ring: Column, p: Column) -> Column:
    """Whether a counter-clockwise convex ring covers a point: it lies left of every side, or on it."""
    return F.forall(pieces(ring), lambda s: cross(s["a"], s["b"], p) >= -ON)


# --- projections -----------------------------------------------------------------------------------------------------

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
#: Standard parallels, origin, false easting and northing (EPSG:5070, EPSG:3083).
ALBERS = {"5070": (29.5, 45.5, 23.0, -96.0, 0.0, 0.0), "3083": (27.5, 35.0, 18.0, -100.0, 1_500_000.0, 6_000_000.0)}


def albers(lon: Column | str, lat: Column | str, code: str = "5070") -> Column:
    """Ellipsoidal Albers equal-area forward projection, metres."""
    p1, p2, p0, l0, fe, fn = ALBERS[code]
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    m_of = lambda s: math.cos(math.asin(s)) / math.sqrt(1 - e2 * s * s)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0, s1, s2 = (math.sin(math.radians(d)) for d in (p0, p1, p2))
    n = (m_of(s1) ** 2 - m_of(s2) ** 2) / (q_of(s2) - q_of(s1))
    c = m_of(s1) ** 2 + n * q_of(s1)
    rho0 = WGS84_A * math.sqrt(c - n * q_of(s0)) / n
    s = F.sin(F.radians(as_col(lat)))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = WGS84_A * F.sqrt(c - n * q) / n
    theta = n * F.radians(as_col(lon) - l0)
    return F.struct((fe + rho * F.sin(theta)).alias("x"), (fn + rho0 - rho * F.cos(theta)).alias("y"))


def web_mercator(lon: Column | str, lat: Column | str) -> Column:
    return F.struct((WGS84_A * F.radians(as_col(lon))).alias("x"), (WGS84_A * F.log(F.tan(math.pi / 4 + F.radians(as_col(lat)) / 2))).alias("y"))


def inverse_albers(x: Column | str, y: Column | str, code: str = "5070", rounds: int = 6) -> Column:
    """Lon and lat of Albers metres; latitude by fixed-point steps from the authalic one."""
    p1, p2, p0, l0, fe, fn = ALBERS[code]
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    m_of = lambda s: math.cos(math.asin(s)) / math.sqrt(1 - e2 * s * s)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0, s1, s2 = (math.sin(math.radians(d)) for d in (p0, p1, p2))
    n = (m_of(s1) ** 2 - m_of(s2) ** 2) / (q_of(s2) - q_of(s1))
    c = m_of(s1) ** 2 + n * q_of(s1)
    rho0 = WGS84_A * math.sqrt(c - n * q_of(s0)) / n
    dx, dy = as_col(x) - fe, rho0 - (as_col(y) - fn)
    rho = F.hypot(dx, dy)
    q = (c - (rho * n / WGS84_A) ** 2) / n
    lat = F.asin(q / 2)
    steps = F.sequence(F.lit(1), F.lit(rounds))

    def step(phi: Column, _: Column) -> Column:
        s = F.sin(phi)
        w = 1 - e2 * s * s
        return phi + w * w / (2 * F.cos(phi)) * (q / (1 - e2) - s / w + F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    lat = F.aggregate(steps, lat, step)
    return F.struct((l0 + F.degrees(F.atan2(dx, dy)) / n).alias("lon"), F.degrees(lat).alias("lat"))


# --- tiles and pairs -------------------------------------------------------------------------------------------------


def closest_points(one: Column | str, two: Column | str) -> Column:
    """``struct<d, p, q>``: the distance of two lines, and where on each they come that near; ends are tried against pieces, crossings have distance 0."""
    a, b = pieces(as_col(one)), pieces(as_col(two))

    def on(p: Column, s: Column) -> Column:
        t = project(p, s["a"], s["b"])
        return F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))

    def pair(p: Column, q: Column) -> Column:
        return F.struct(F.hypot(p["x"] - q["x"], p["y"] - q["y"]).alias("d"), p.alias("p"), q.alias("q"))

    def meeting(s: Column, r: Column) -> Column:
        dx, dy, ex, ey = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"], r["b"]["x"] - r["a"]["x"], r["b"]["y"] - r["a"]["y"]
        t = F.try_divide((r["a"]["x"] - s["a"]["x"]) * ey - (r["a"]["y"] - s["a"]["y"]) * ex, dx * ey - dy * ex)
        p = F.struct((s["a"]["x"] + t * dx).alias("x"), (s["a"]["y"] + t * dy).alias("y"))
        return F.when(pieces_cross(s["a"], s["b"], r["a"], r["b"]), F.struct(F.lit(ZERO).alias("d"), p.alias("p"), p.alias("q")))

    def of(s: Column, r: Column) -> Column:
        ends = [pair(s[k], on(s[k], r)) for k in "ab"] + [pair(on(r[k], s), r[k]) for k in "ab"]
        return F.array(*ends, meeting(s, r))

    found = F.flatten(F.transform(a, lambda s: F.flatten(F.transform(b, lambda r: of(s, r)))))
    return F.array_min(F.filter(found, lambda x: x.isNotNull()))


def square_tiles(box: Column | str, size: float, margin: float = 0.0) -> Column:
    """Squares of ``size`` over a box with a margin, ``array<struct<cx, cy, xmin, xmax, ymin, ymax>>``, from its lower left corner."""
    b = as_col(box)
    n = lambda lo, hi: F.greatest(F.lit(1), F.ceil((b[hi] - b[lo] + 2 * margin) / size)).cast("int")

    def tile(i: Column, j: Column) -> Column:
        x, y = b["xmin"] - margin + i * size, b["ymin"] - margin + j * size
        return F.struct(i.alias("cx"), j.alias("cy"), x.alias("xmin"), (x + size).alias("xmax"), y.alias("ymin"), (y + size).alias("ymax"))

    xs, ys = F.sequence(F.lit(0), n("xmin", "xmax") - 1), F.sequence(F.lit(0), n("ymin", "ymax") - 1)
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: tile(i, j))))
