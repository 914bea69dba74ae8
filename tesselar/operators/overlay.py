"""Overlay of polygons of any shape: areas that two tables of edges share, and points in faces, as joins of edges in strips.

A polygon is its directed edges, outer rings counter-clockwise and holes clockwise. Let s be +1 for an edge that runs to the left and -1 for one that
runs to the right: at every x, a polygon's edges have the sum 0, and the length of the line at x inside both of two polygons is half the sum of
-s t |y(e) - y(f)| over all their pairs of edges e, f there. So the shared area is the sum over pairs of edges of

    -(s t / 2) * (integral of |y(e) - y(f)| over the x that both have),

which has a closed form where edges are straight. No crossing points are made, edges may lie on one another, and rings may be concave or have holes. Pairs of polygons come from
their boxes; a pair's edges meet only in strips of its common x-range, of which it has as many as its edges make worth while.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.operators.cells import boxes_meet, points_in_boxes, renamed

#: Edges of a polygon that share a strip, were they dealt evenly.
EVEN = 8


def ring_edges(df: DataFrame, *keep: str, ring: str = "ring") -> DataFrame:
    """``keep`` and ux, uy, vx, vy of every side of a simple ring (array of x, y; closed or not), counter-clockwise whichever way it runs."""
    r = F.col(ring)
    n = F.size(r)
    following = F.concat(F.slice(r, 2, F.greatest(n - 1, F.lit(0))), F.slice(r, 1, 1))
    sides = F.transform(F.arrays_zip(r.alias("u"), following.alias("v")), lambda e: F.struct(e["u"]["x"].cast("double").alias("ux"), e["u"]["y"].cast("double").alias("uy"), e["v"]["x"].cast("double").alias("vx"), e["v"]["y"].cast("double").alias("vy")))
    origin = F.element_at(r, 1)
    turn = lambda e: (e["ux"] - origin["x"]) * (e["vy"] - origin["y"]) - (e["vx"] - origin["x"]) * (e["uy"] - origin["y"])
    signed = F.aggregate(F.col("sides"), F.lit(0.0), lambda a, e: a + turn(e))
    rows = df.where(n > 2).select(*keep, ring, sides.alias("sides")).select(*keep, (signed < 0).alias("back"), F.explode("sides").alias("e"))
    pick = lambda one, other: F.when(F.col("back"), F.col(f"e.{other}")).otherwise(F.col(f"e.{one}"))
    return rows.select(*keep, pick("ux", "vx").alias("ux"), pick("uy", "vy").alias("uy"), pick("vx", "ux").alias("vx"), pick("vy", "uy").alias("vy"))


def boxes(edges: DataFrame, *by: str) -> DataFrame:
    """Box and number of edges of every polygon."""
    return edges.groupBy(*by).agg(*(f(c).alias(n) for f, c, n in ((F.min, "ux", "x0"), (F.min, "uy", "y0"), (F.max, "ux", "x1"), (F.max, "uy", "y1"))), F.count("*").alias("edges"))


def shared_areas(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("drawing_id",), cell: float = 4000.0, own: bool = False) -> DataFrame:
    """keys, a, b, shared for polygons of the tables ``a`` and ``b`` (keys, id, ux, uy, vx, vy) whose boxes meet. ``own``: both are one table, a < b."""
    near = boxes_meet(renamed(boxes(a, *keys, "id"), "a", *keys), renamed(boxes(b, *keys, "id"), "b", *keys), cell, keys=keys)
    if own:
        near = near.where("aid < bid")
    low, high = F.greatest("ax0", "bx0"), F.least("ax1", "bx1")
    strips = F.greatest(F.lit(1), F.floor((F.col("aedges") + F.col("bedges")) / (2 * EVEN)))
    pairs = near.select(*keys, "aid", "bid", low.alias("low"), high.alias("high"), strips.cast("bigint").alias("strips"))

    def side(edges: DataFrame, p: str) -> DataFrame:
        flat = edges.where("ux <> vx").select(*keys, F.col("id").alias(f"{p}id"), *(f(F.col("ux"), F.col("vx")).alias(n) for f, n in ((F.least, "l"), (F.greatest, "r"))), F.col("ux").alias("x"), F.col("uy").alias("y"), ((F.col("vy") - F.col("uy")) / (F.col("vx") - F.col("ux"))).alias("m"), F.when(F.col("ux") > F.col("vx"), 1.0).otherwise(-1.0).alias("s"))
        met = pairs.join(flat, [*keys, f"{p}id"]).where((F.col("l") < F.col("high")) & (F.col("r") > F.col("low")))
        width = (F.col("high") - F.col("low")) / F.col("strips")
        at = lambda x: F.least(F.col("strips") - 1, F.floor((x - F.col("low")) / width)).cast("bigint")
        cut = met.withColumn("strip", F.explode(F.sequence(at(F.greatest("l", "low")), at(F.least("r", "high")))))
        border = lambda k: F.col("low") + k * width
        return cut.select(*keys, "aid", "bid", "strip", F.greatest("l", border(F.col("strip"))).alias(f"{p}l"), F.least("r", border(F.col("strip") + 1)).alias(f"{p}r"), *(F.col(c).alias(p + c) for c in "xyms"))

    both = side(a, "a").join(side(b, "b"), [*keys, "aid", "bid", "strip"])
    left, right = F.greatest("al", "bl"), F.least("ar", "br")
    height = lambda p, x: F.col(f"{p}y") + (x - F.col(f"{p}x")) * F.col(f"{p}m")
    both = both.where(left < right).select(*keys, "aid", "bid", (right - left).alias("w"), (F.col("as") * F.col("bs")).alias("sign"), (height("a", left) - height("b", left)).alias("d"), (height("a", right) - height("b", right)).alias("e"))
    between = _between(F.col("d"), F.col("e")) * F.col("w")
    total = both.groupBy(*keys, F.col("aid").alias("a"), F.col("bid").alias("b")).agg((F.sum(F.col("sign") * between) / -2).alias("shared"))
    return total.withColumn("shared", F.greatest(F.lit(0.0), "shared"))


def _between(d: Column, e: Column) -> Column:
    """Mean of |y| along a straight line from d to e."""
    size = F.abs(d) + F.abs(e)
    return F.when(d * e >= 0, size / 2).otherwise((d * d + e * e) / F.nullif(2 * size, F.lit(0.0)))


def polygon_areas(edges: DataFrame, *by: str) -> DataFrame:
    return edges.groupBy(*by).agg((F.sum((F.col("ux") - F.col("vx")) * (F.col("uy") + F.col("vy"))) / 2).alias("area"))


def with_iou(shared: DataFrame, a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """``shared`` with both areas and the share of the union that is common."""
    area = lambda df, p: polygon_areas(df, *keys, "id").select(*keys, F.col("id").alias(p), F.col("area").alias(f"{p}_area"))
    both = shared.join(area(a, "a"), [*keys, "a"]).join(area(b, "b"), [*keys, "b"])
    union = F.col("a_area") + F.col("b_area") - F.col("shared")
    return both.withColumn("iou", F.when(union > 0, F.col("shared") / union).otherwise(0.0))


def most_shared(shared: DataFrame, keys: tuple[str, ...] = ("drawing_id",), least: float = 0.0) -> DataFrame:
    """For every a the b that it shares most with, more than ``least``; ties to the smaller b."""
    best = F.max(F.struct("shared", (-F.col("b")).alias("k"), "b"))
    return shared.where(F.col("shared") > least).groupBy(*keys, "a").agg(best.alias("m")).select(*keys, "a", F.col("m.b").alias("b"), F.col("m.shared").alias("shared"))


# ---- points in faces ----------------------------------------------------------------------------


def crossings(points: DataFrame, faces: DataFrame, edges: DataFrame, point: list[str], size: float, keys: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """keys, point, face, k and touches for points (x, y) in the boxes of faces (face, x0, y0, x1, y1): how many edges of the face lie to the right
    on the point's own height, and whether one starts in the point.

    Every face is cut into strips of its height, as many as its edges make worth while; a point meets the edges of its own strip, some ten
    however many the face has.
    """
    several = edges.groupBy(*keys, "face").agg(F.count("*").alias("edges"))
    strips = F.greatest(F.lit(1), F.floor(F.col("edges") / EVEN)).cast("bigint")
    cut = faces.select(*keys, "face", "x0", "y0", "x1", "y1").join(several, [*keys, "face"]).withColumns({"strips": strips, "width": F.greatest((F.col("y1") - F.col("y0")) / strips, F.lit(1e-9))})
    at = lambda y: F.greatest(F.lit(0), F.least(F.col("strips") - 1, F.floor((y - F.col("y0")) / F.col("width")))).cast("bigint")
    near = points_in_boxes(points, cut, size, keys=keys).select(*keys, *point, "x", "y", "face", at(F.col("y")).alias("strip"))
    sides = edges.join(cut.select(*keys, "face", "y0", "strips", "width"), [*keys, "face"])
    sides = sides.select(*keys, "face", "ux", "uy", "vx", "vy", F.explode(F.sequence(at(F.least("uy", "vy")), at(F.greatest("uy", "vy")))).alias("strip"))
    over = (F.col("uy") > F.col("y")) != (F.col("vy") > F.col("y"))
    right = F.col("ux") + (F.col("y") - F.col("uy")) * (F.col("vx") - F.col("ux")) / F.nullif((F.col("vy") - F.col("uy")).cast("double"), F.lit(0.0))
    touch = (F.col("ux") == F.col("x")) & (F.col("uy") == F.col("y"))
    return near.join(sides, [*keys, "face", "strip"]).groupBy(*keys, *point, "face").agg(F.count_if(over & (F.col("x") < right)).alias("k"), F.bool_or(touch).alias("touches"))
