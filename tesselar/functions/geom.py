"""Planar geometry as column expressions. A ring is an array of struct(x, y) without the closing point."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point(x: Column, y: Column) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def rect_ring(x0: Column | str = "x0", y0: Column | str = "y0", x1: Column | str = "x1", y1: Column | str = "y1") -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def sides(ring: Column) -> Column:
    """Array of struct(a, b): consecutive points, the last with the first."""
    return F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))


def _total(ring: Column, term) -> Column:
    return F.aggregate(sides(ring), F.lit(0.0), lambda t, s: t + term(s["a"], s["b"]))


def signed_area(ring: Column) -> Column:
    return _total(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def ring_area(ring: Column, scale: float = 1.0) -> Column:
    return F.abs(signed_area(ring)) * (scale * scale)


def ring_perimeter(ring: Column, scale: float = 1.0) -> Column:
    return _total(ring, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])) * scale


def ring_centroid(ring: Column) -> Column:
    area = signed_area(ring) * 6
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    return F.when(area == 0, vertex_mean(ring)).otherwise(
        F.struct((_total(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / F.nullif(area, F.lit(0.0))).alias("x"), (_total(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / F.nullif(area, F.lit(0.0))).alias("y"))
    )


def vertex_mean(ring: Column) -> Column:
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def ring_bounds(ring: Column) -> Column:
    ends = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(ends(F.array_min, "x").alias("x0"), ends(F.array_min, "y").alias("y0"), ends(F.array_max, "x").alias("x1"), ends(F.array_max, "y").alias("y1"))


def volume(area: Column, thickness: float) -> Column:
    return area * thickness


def _crosses(x: Column, y: Column, a, b) -> Column:
    """Whether the side from a to b crosses the half line to the right of the point."""
    straddles = (a["y"] > y) != (b["y"] > y)
    at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
    return F.coalesce(straddles & (x < at), F.lit(False))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: sides that cross the half line to the right, counted odd."""
    return F.aggregate(sides(ring), F.lit(False), lambda t, s: t != _crosses(x, y, s["a"], s["b"]))


def point_in_corners(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """``point_in_ring`` for so many corners, written out: Spark compiles it, where it steps through a ring of any length."""
    at = [{"x": cx.cast("double"), "y": cy.cast("double")} for cx, cy in corners]
    odd = F.lit(False)
    for a, b in zip(at, at[1:] + at[:1], strict=True):
        odd = odd != _crosses(x, y, a, b)
    return odd


def point_segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def ring_boundary_distance(x: Column, y: Column, ring: Column) -> Column:
    return F.array_min(F.transform(sides(ring), lambda s: point_segment_distance(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def point_in_ring_eps(x: Column, y: Column, ring: Column, eps: float = 1.0) -> Column:
    return point_in_ring(x, y, ring) | (ring_boundary_distance(x, y, ring) <= eps)


def segment_intersection(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Crossing point of two segments, null without one (parallel ones have none)."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(den.cast("double"), F.lit(0.0))
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.nullif(den.cast("double"), F.lit(0.0))
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def segment_angle(ax, ay, bx, by) -> Column:
    """Degrees from 0 up to, but without, 180."""
    return F.pmod(F.degrees(F.atan2((by - ay).cast("double"), (bx - ax).cast("double"))), F.lit(180.0))


def normal_position(angle: Column, x: Column, y: Column) -> Column:
    """Signed offset along the normal, angles folded to (-90, 90] first."""
    folded = F.radians(F.when(angle > 90, angle - 180).otherwise(angle))
    return -x * F.sin(folded) + y * F.cos(folded)


def angle_delta(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def axis_angle_delta(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def is_orthogonal(angle: Column, tolerance: float = 2.0) -> Column:
    d = F.pmod(angle, F.lit(90.0))
    return F.least(d, 90.0 - d) <= tolerance


def round_point(x: Column) -> Column:
    """Key of a coordinate: six decimals as an integer."""
    return F.round(x.cast("double") * 1_000_000).cast("bigint")


#: Fixed values of the bridge cost, the wall-offset profile and the micro gap. FACING is a cost, the others are factors.
ALIGNED, LARGE_DELTA, PROFILE_CAP, FACING = 0.85, 0.75, 0.35, 0.01
PROFILE_DISTANCES, PROFILE_TOLERANCE, PROFILE_DELTA, MICRO_GAP, MAX_GAP_ANGLE = (150.0, 180.0), 5.0, 135.0, 15.0, 30.0


def profile_distance(distance: Column) -> Column:
    return (F.abs(distance - PROFILE_DISTANCES[0]) <= PROFILE_TOLERANCE) | (F.abs(distance - PROFILE_DISTANCES[1]) <= PROFILE_TOLERANCE)


def is_wall_offset_profile(distance: Column, delta: Column) -> Column:
    return profile_distance(distance) & F.coalesce(delta >= PROFILE_DELTA, F.lit(False))


def aligned(delta: Column, max_angle: float = MAX_GAP_ANGLE) -> Column:
    """Bearings that run alike (five degrees are forgiven), at a right angle, or against each other."""
    return (delta <= max_angle + 5) | (F.abs(delta - 90) <= 5) | (F.abs(delta - 180) <= 5)


def is_micro_gap(distance: Column, delta: Column, limit: float = MICRO_GAP, max_angle: float = MAX_GAP_ANGLE) -> Column:
    return (distance <= limit) & F.coalesce(aligned(delta, max_angle), F.lit(True))


def bridge_cost(distance: Column, delta: Column, max_angle: float = MAX_GAP_ANGLE) -> Column:
    """Ends that face each other over a profile distance cost next to nothing; aligned ends and large turns are cheaper than others; any
    profile distance has a cap. A null delta is an end without bearing."""
    facing = (F.abs(delta - 180) <= 5) & profile_distance(distance)
    plain = F.when(aligned(delta, max_angle), distance * ALIGNED).when(delta > max_angle + 45, distance * LARGE_DELTA).otherwise(distance)
    return F.when(facing, F.lit(FACING)).when(profile_distance(distance), F.least(plain, distance * PROFILE_CAP)).otherwise(plain)


def point_segment_square(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point and a segment; whole where all numbers are and the segment runs along an axis."""
    x, y, ax, ay, bx, by = (c.cast("double") for c in (x, y, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    along, length = (x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy
    square = lambda u, v: u * u + v * v
    cross = dx * (y - ay) - dy * (x - ax)
    return F.when(along <= 0, square(x - ax, y - ay)).when(along >= length, square(x - bx, y - by)).otherwise(cross * cross / F.nullif(length, F.lit(0.0)))


def suggested_threshold(distance: Column, threshold: float) -> Column:
    """The threshold if it reaches, else the distance raised to the next hundred."""
    return F.when(distance <= threshold, F.lit(float(threshold))).otherwise(F.greatest(F.ceil(distance / 100) * 100.0, distance))


def clip_rect_area(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a ring inside an axis-aligned rectangle: four half-plane clips, folded over the ring so that no step repeats those before it."""
    plane = lambda upright, bound, low: F.struct(F.lit(upright).alias("upright"), bound.cast("double").alias("bound"), F.lit(low).alias("low"))
    planes = F.array(plane(True, x0, True), plane(True, x1, False), plane(False, y0, True), plane(False, y1, False))
    plain = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.aggregate(planes, plain, _half_plane, lambda out: F.when(F.size(out) < 3, F.lit(0.0)).otherwise(ring_area(out)))


def _half_plane(ring: Column, plane: Column) -> Column:
    """The part of a ring on the inner side of a line along an axis."""
    at = lambda p: F.when(plane["upright"], p["x"]).otherwise(p["y"])
    inside = lambda p: F.when(plane["low"], at(p) >= plane["bound"]).otherwise(at(p) <= plane["bound"])

    def step(s: Column) -> Column:
        a, b = s["a"], s["b"]
        t = (plane["bound"] - at(a)) / F.nullif(at(b) - at(a), F.lit(0.0))
        crossing = F.struct(F.when(plane["upright"], plane["bound"]).otherwise(a["x"] + t * (b["x"] - a["x"])).alias("x"), F.when(plane["upright"], a["y"] + t * (b["y"] - a["y"])).otherwise(plane["bound"]).alias("y"))
        none = F.slice(ring, 1, 0)
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(crossing)).when(inside(b), F.array(crossing, b)).otherwise(none)

    return F.flatten(F.transform(sides(ring), step))


def ring_validity(ring: Column) -> Column:
    """At least three points, some area, and no two sides that properly cross."""

    def side(p, q, r):
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def cross(s, t):
        a, b, c, d = s["a"], s["b"], t["a"], t["b"]
        return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)

    every = sides(ring)
    return (F.size(ring) >= 3) & ~F.exists(every, lambda s: F.exists(every, lambda t: cross(s, t))) & (ring_area(ring) > 0)


def normalize_ring(points: Column) -> Column:
    """Points without nulls and NaN, and without a closing point that repeats the first."""
    good = F.filter(points, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.when((F.size(good) > 1) & (F.element_at(good, 1) == F.element_at(good, -1)), F.slice(good, 1, F.size(good) - 1)).otherwise(good)


def factor_pairs(n: Column) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(1).cast("bigint"), n), lambda a: n % a == 0), lambda a: F.struct(a.alias("a"), (n / a).cast("bigint").alias("b")))


def factor_near_square(n: Column) -> Column:
    fits = F.filter(factor_pairs(n), lambda p: p["a"] <= p["b"])
    return F.element_at(fits, -1)


def circle_ring(x: Column, y: Column, radius: Column, per_quadrant: int = 32) -> Column:
    step = 2 * math.pi / (4 * per_quadrant)
    return F.transform(F.sequence(F.lit(0), F.lit(4 * per_quadrant - 1)), lambda k: F.struct((x + radius * F.cos(k * step)).alias("x"), (y + radius * F.sin(k * step)).alias("y")))


def arc_points(x: Column, y: Column, radius: Column, start: Column, end: Column, n: int = 64) -> Column:
    sweep = F.pmod(end - start, F.lit(360.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.struct((x + radius * F.cos(F.radians(start + sweep * k / n))).alias("x"), (y + radius * F.sin(F.radians(start + sweep * k / n))).alias("y")))


def placeholder_footprint(x: Column, y: Column, side: float = 400.0) -> Column:
    h = side / 2
    return rect_ring(x - h, y - h, x + h, y + h)


def iou(shared: Column, a: Column, b: Column) -> Column:
    return F.coalesce(shared / F.nullif((a + b - shared).cast("double"), F.lit(0.0)), F.lit(0.0))
