"""Distance and box joins as equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(x: Column, size: float | Column) -> Column:
    return F.floor(x / size).cast("bigint")


def _range(low: Column, high: Column, size: float | Column) -> Column:
    return F.sequence(_cell(low, size), _cell(high, size))


def with_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumn("cx", _cell(F.col(x), size)).withColumn("cy", _cell(F.col(y), size))


def _meet(own: DataFrame, spread: DataFrame, on: list[str]) -> DataFrame:
    """An equi-join on cells by shuffle. Spark takes a table for as small as it was before its rows went to several cells, and would gather it in the driver."""
    return own.join(spread.hint("merge"), on)


def near_points(a: DataFrame, b: DataFrame, distance: float, keys: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """Pairs of a row of ``a`` (ax, ay) and one of ``b`` (bx, by) at most ``distance`` apart, with d2. ``b`` goes to its 3 x 3 cells."""
    own = with_cell(a, "ax", "ay", distance)
    spread = b.withColumn("cx", F.explode(_range(F.col("bx") - distance, F.col("bx") + distance, distance))).withColumn("cy", F.explode(_range(F.col("by") - distance, F.col("by") + distance, distance)))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return _meet(own, spread, [*keys, "cx", "cy"]).drop("cx", "cy").withColumn("d2", d2).where(F.col("d2") <= distance * distance)


def having_near(a: DataFrame, b: DataFrame, distance: float, keys: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """Rows of ``a`` (x, y), each once, with a point of ``b`` (x, y) at most ``distance`` away.

    In a cell of half that side all points are near each other, so a row whose own cell has a point is done, and one without a point in
    the 5 x 5 cells around it too. Only rows between these meet points.
    """
    size = distance / 2
    at = [*keys, "cx", "cy"]
    b = b.select(*keys, "x", "y").distinct()
    marks = with_cell(b, "x", "y", size).select(*at).distinct()
    around = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i in range(-2, 3) for j in range(-2, 3)))
    known = marks.select(*keys, F.explode(around).alias("e")).groupBy(*keys, "e.cx", "e.cy").agg(F.bool_or("e.own").alias("own"))
    found = _meet(with_cell(a, "x", "y", size), known, at)
    rest = found.where("not own").select(*a.columns, F.col("x").alias("bx"), F.col("y").alias("by"))
    met = near_points(b.select(*keys, F.col("x").alias("ax"), F.col("y").alias("ay")), rest, distance)
    return found.where("own").select(*a.columns).unionByName(met.select(*a.columns)).distinct()


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, keys: tuple[str, ...] = ("drawing_id",), pad: float = 0.0, few: bool = False) -> DataFrame:
    """Pairs of a point (x, y) and a box (x0, y0, x1, y1) that holds it, border included. ``few``: there are few boxes; Spark sees their size."""
    own = with_cell(points, "x", "y", size)
    spread = boxes.withColumn("cx", F.explode(_range(F.col("x0") - pad, F.col("x1") + pad, size))).withColumn("cy", F.explode(_range(F.col("y0") - pad, F.col("y1") + pad, size)))
    inside = F.col("x").between(F.col("x0") - pad, F.col("x1") + pad) & F.col("y").between(F.col("y0") - pad, F.col("y1") + pad)
    on = [*keys, "cx", "cy"]
    return (own.join(spread, on) if few else _meet(own, spread, on)).drop("cx", "cy").where(inside)


def boxes_meet(a: DataFrame, b: DataFrame, size: float, keys: tuple[str, ...] = ("drawing_id",), few: bool = False) -> DataFrame:
    """Pairs of boxes (ax0.. and bx0..) with a common interior. A pair counts in the cell of its common lower corner alone. ``few``: b has few rows."""
    spread = lambda df, p: df.withColumn("cx", F.explode(_range(F.col(f"{p}x0"), F.col(f"{p}x1"), size))).withColumn("cy", F.explode(_range(F.col(f"{p}y0"), F.col(f"{p}y1"), size)))
    on = [*keys, "cx", "cy"]
    both = spread(a, "a").join(spread(b, "b"), on) if few else _meet(spread(a, "a"), spread(b, "b"), on)
    low = [F.greatest(f"a{c}0", f"b{c}0") for c in "xy"]
    high = [F.least(f"a{c}1", f"b{c}1") for c in "xy"]
    home = (F.col("cx") == _cell(low[0], size)) & (F.col("cy") == _cell(low[1], size))
    return both.where(home & (low[0] < high[0]) & (low[1] < high[1])).drop("cx", "cy").withColumn("shared", (high[0] - low[0]) * (high[1] - low[1]))


def alike_boxes(a: DataFrame, b: DataFrame, percent: int, keys: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """Pairs of boxes (ax0.. and bx0..) whose common part, ``shared``, is at least so many per cent of their union.

    With a share of t, each side of one box is at least t times that of the other, and their lower corners differ by at most (1 - t) / t of a side. So boxes meet
    by classes of width and height and in cells as small as that: the work does not grow with the pairs that merely overlap.
    """
    t = percent / 100
    step = max(1 / t, 1.001) ** 4
    level = lambda x, turn=0.0: F.floor((F.log(x.cast("double")) + turn) / math.log(step)).cast("bigint")
    sides = {"x": "w", "y": "h"}
    size = lambda c: F.pow(F.lit(step), F.col(f"l{sides[c]}") + 1) * (4 * max(1 - t, 0.001))
    own, spread = (df.where((F.col(f"{p}x0") < F.col(f"{p}x1")) & (F.col(f"{p}y0") < F.col(f"{p}y1"))) for df, p in ((a, "a"), (b, "b")))
    slack = 1e-9 - math.log(t)
    for c, side in sides.items():
        own = own.withColumn(f"l{side}", level(F.col(f"a{c}1") - F.col(f"a{c}0")))
        own = own.withColumn(f"c{c}", _cell(F.col(f"a{c}0"), size(c)))
        long = F.col(f"b{c}1") - F.col(f"b{c}0")
        spread = spread.withColumn(f"l{side}", F.explode(F.sequence(level(long, -slack), level(long, slack))))
        off = long * ((1 - t) / t) + 1e-6
        spread = spread.withColumn(f"c{c}", F.explode(_range(F.col(f"b{c}0") - off, F.col(f"b{c}0") + off, size(c))))
    at = ["lw", "lh", "cx", "cy"]
    low = [F.greatest(f"a{c}0", f"b{c}0") for c in "xy"]
    high = [F.least(f"a{c}1", f"b{c}1") for c in "xy"]
    both = _meet(own, spread, [*keys, *at]).drop(*at).where((low[0] < high[0]) & (low[1] < high[1])).withColumn("shared", (high[0] - low[0]) * (high[1] - low[1]))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    return both.where(100 * F.col("shared") >= percent * (area("a") + area("b") - F.col("shared")))


def by_area(boxes: DataFrame, groups: float, ground: float) -> list[tuple[DataFrame, float, float]]:
    """The boxes (x0, y0, x1, y1, area) in parts, the smallest first: rows, a cell's side, and the least area. A part covers each of so many grounds of
    that area about four times as often as all before it. The driver sees one row for each doubling of the area."""
    bucket = F.floor(F.log2(F.col("area").cast("double") + 1) * 2).cast("int")
    rows = boxes.where("x0 <= x1 and y0 <= y1").withColumn("_k", bucket)
    kinds = sorted(rows.groupBy("_k").agg(F.sum(F.col("area").cast("double")), F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.min("area")).collect())
    parts: list[list] = []
    seen = now = 0.0
    for kind in kinds:
        if not parts or now > max(2 * groups * ground, 3 * seen):
            seen, now = seen + now, 0.0
            parts.append([])
        parts[-1].append(kind)
        now += kind[1]
    return [(rows.where(F.col("_k").between(p[0][0], p[-1][0])).drop("_k"), max(1.0, float(max(k[2] for k in p))), float(p[0][3])) for p in parts]


def smallest_holding(points: DataFrame, boxes: DataFrame, tie: str, steps, keys: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """keys, x, y and the smallest of the boxes (area, tie and others) that hold the point, border included; places without one have no row, each place is asked once.

    Boxes come in parts, the smallest first, and a point that has its box meets no larger ones: the work does not grow with all boxes over a point.
    """
    at = [*keys, "x", "y"]
    left = steps.cut(points.select(*at).distinct())
    boxes = steps.cut(boxes)
    r = left.agg(F.max("x"), F.min("x"), F.max("y"), F.min("y"), F.count_distinct(*keys)).first()
    ground = (float(r[0] - r[1]) + 1) * (float(r[2] - r[3]) + 1) if r[0] is not None else 1.0
    best = F.min(F.struct("area", tie, *[c for c in boxes.columns if c not in (*keys, "area", tie)]))
    out = None
    for part, size, _ in by_area(boxes, max(r[4], 1), ground):
        found = steps.cut(points_in_boxes(left, part, size, keys=keys).groupBy(*at).agg(best.alias("b")))
        out = found if out is None else out.unionByName(found)
        left = steps.cut(left.join(found.select(*at), at, "left_anti"))
        if left.isEmpty():
            break
    return out if out is not None else left.join(boxes.limit(0).groupBy(*keys).agg(best.alias("b")), list(keys))


def renamed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """Columns with a prefix, but for those to keep."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


def widening(rows: DataFrame, ids: list[str], found, first: float, extent: float, steps, factor: float = 4.0) -> DataFrame:
    """Answers of ``found(rows, reach)`` (one row by id at most, complete within the reach) for a reach that grows until no row is left without
    one or the reach passes the tables' extent. Rows that have an answer do not search again."""
    left, parts, reach = rows, [], first
    while True:
        best = steps.cut(found(left, reach))
        parts.append(best)
        if reach > extent:
            break
        left = steps.cut(left.join(best.select(*ids), ids, "left_anti"))
        if left.isEmpty():
            break
        reach *= factor
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extent(*tables: DataFrame) -> float:
    """The diagonal of the box around all points (x, y)."""
    both = tables[0].select("x", "y")
    for t in tables[1:]:
        both = both.unionByName(t.select("x", "y"))
    r = both.agg(F.max("x"), F.min("x"), F.max("y"), F.min("y")).first()
    return float(((r[0] - r[1]) ** 2 + (r[2] - r[3]) ** 2) ** 0.5) if r[0] is not None else 0.0
