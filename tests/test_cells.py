"""Joins on cells against brute force, and how they are run."""

import random

import pytest
from pyspark.sql import functions as F

from tesselar.operators import cells as C

POINT = "drawing_id long, k long, x long, y long"
BOX = "drawing_id long, k long, x0 long, y0 long, x1 long, y1 long"


def points(rng, n, size):
    return [(rng.randrange(2), k, rng.randrange(-size, size), rng.randrange(-size, size)) for k in range(n)]


@pytest.mark.parametrize("size", [40, 300, 2000])
def test_rows_that_have_a_point_in_reach(spark, size):
    rng = random.Random(size)
    a, b = points(rng, 150, size), points(rng, 60, size)
    got = C.having_near(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), 50)
    want = [p for p in a if any(p[0] == q[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 2500 for q in b)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_dealt_to_cells_are_never_gathered_in_the_driver(spark, tmp_path):
    path = f"{tmp_path}/points"
    spark.createDataFrame(points(random.Random(1), 50, 100), POINT).write.parquet(path)
    p = spark.read.parquet(path)
    side = lambda s: p.selectExpr("drawing_id", f"x as {s}x", f"y as {s}y")
    box = p.selectExpr("drawing_id", "x as x0", "y as y0", "x + 5 as x1", "y + 5 as y1")
    named = lambda s: C.renamed(box, s, "drawing_id")
    for df in (C.near_points(side("a"), side("b"), 10), C.points_in_boxes(p, box, 10), C.boxes_meet(named("a"), named("b"), 10), C.having_near(p, p, 10)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def boxes(rng, n, size, side):
    rows = [(rng.randrange(2), k, rng.randrange(size), rng.randrange(size), rng.randrange(side), rng.randrange(side)) for k in range(n)]
    return [(d, k, x, y, x + w, y + h) for d, k, x, y, w, h in rows]


@pytest.mark.parametrize("percent", [90, 95, 98])
def test_alike_boxes(spark, percent):
    rng = random.Random(percent)
    a = boxes(rng, 150, 400, 300)
    b = [(d, k, x0 + rng.randrange(-2, 3), y0 + rng.randrange(-2, 3), x1, y1 + rng.randrange(-2, 3)) for d, k, x0, y0, x1, y1 in a]
    named = lambda rows, s: C.renamed(spark.createDataFrame(rows, BOX), s, "drawing_id")

    def share(p, q):
        w, h = (min(p[c + 4], q[c + 4]) - max(p[c + 2], q[c + 2]) for c in (0, 1))
        size = sum((r[4] - r[2]) * (r[5] - r[3]) for r in (p, q))
        return w > 0 and h > 0 and 100 * w * h >= percent * (size - w * h)

    got = C.alike_boxes(named(a, "a"), named(b, "b"), percent)
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and share(p, q))
    assert want and sorted((r.ak, r.bk) for r in got.collect()) == want


def test_smallest_box_that_holds_a_point(spark):
    from tesselar.operators.state import Steps

    rng = random.Random(3)
    b, p = boxes(rng, 800, 600, 400), [(d, k, x % 900, y % 900) for d, k, x, y in points(rng, 200, 900)]
    rows = spark.createDataFrame(b, BOX).selectExpr("*", "(x1 - x0) * (y1 - y0) as area")
    got = {(r.drawing_id, r.x, r.y): (r.b.area, r.b.k) for r in C.smallest_holding(spark.createDataFrame(p, POINT), rows, "k", Steps(spark)).collect()}
    held = {q: min(((r[4] - r[2]) * (r[5] - r[3]), r[1]) for r in b if r[0] == q[0] and r[2] <= q[1] <= r[4] and r[3] <= q[2] <= r[5]) for q in {(d, x, y) for d, _, x, y in p} if any(r[0] == q[0] and r[2] <= q[1] <= r[4] and r[3] <= q[2] <= r[5] for r in b)}
    assert got == held
    assert len(C.by_area(rows, 2, 600.0 * 600)) > 2


def test_polygon_overlaps_are_rounded_once(spark):
    from tesselar.plans.joins import polygon_overlaps

    names = "face_id long, drawing_id long, x0 double, xm double, x1 double, y0 double, y1 double, y2 double, ym double, y3 double"
    left = 56.7831265  # 4321.68735 in common: above the border at .6873, as thousandths below it
    rows = [(k, 1, x, x + 50, x + 100, 0.0, 0.0, 100.0, 100.0, 100.0) for k, x in ((1, 0.0), (2, left))]
    assert [r.shared for r in polygon_overlaps(spark.createDataFrame(rows, names)).collect()] == [4322]


def test_zone_pairs_that_few_boxes_do_not_show(spark):
    from tesselar.plans.joins import zone_pairs

    rng = random.Random(5)
    rows = [(*r, f"z{r[1] % 7}") for r in boxes(rng, 80, 3000, 900)]
    got = zone_pairs(spark.createDataFrame(rows, BOX + ", zone string").withColumnRenamed("k", "face_id"), 50_000, first=16)
    cut = lambda p, q: max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
    want = {(min(p[6], q[6]), max(p[6], q[6])) for p in rows for q in rows if p[0] == q[0] and p[6] != q[6] and cut(p, q) > 50_000}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_box_that_only_touches_a_seeds_face_repeats_nothing(spark):
    from tesselar.plans.joins import auto_duplicates

    face = spark.createDataFrame([(1, 1, 100, 50, 10_000, 7, 0, 0, 100, 100)], "seed_id long, drawing_id long, x long, y long, a long, face_id long, x0 long, y0 long, x1 long, y1 long")
    auto = spark.createDataFrame([(1, 3, 100, 0, 200, 100), (1, 5, 50, 0, 150, 100)], BOX).withColumnRenamed("k", "face_id")
    assert [r.face_id for r in auto_duplicates(face, auto).collect()] == [5]


@pytest.mark.parametrize("side,most", [(60, 200), (400, 500), (3000, 4000)])
def test_parts_by_far_fewer_links_than_overlaps(spark, side, most):
    from tesselar.operators.state import Steps
    from tesselar.operators.zones import linked_boxes, zone_parts

    rng = random.Random(side)
    rows = [r for r in boxes(rng, 240, most, side) if r[2] < r[4] and r[3] < r[5]]
    rows += [(d, k + 1000, x1, y0, x1 + 5, y1) for d, k, x0, y0, x1, y1 in rows[:20]]  # along an edge
    rows += [(d, k + 2000, x1, y1, x1 + 5, y1 + 5) for d, k, x0, y0, x1, y1 in rows[:20]]  # at a corner
    up = {r[1]: r[1] for r in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    pairs = 0
    for p in rows:
        for q in rows:
            w, h = (min(p[c + 4], q[c + 4]) - max(p[c + 2], q[c + 2]) for c in (0, 1))
            if p[1] < q[1] and p[0] == q[0] and ((w > 0 and h >= 0) or (w >= 0 and h > 0)):
                pairs += 1
                a, b = find(p[1]), find(q[1])
                up[max(a, b)] = min(a, b)
    table = spark.createDataFrame(rows, BOX).selectExpr("drawing_id", "1L as bay_id", "k as face_id", "x0", "y0", "x1", "y1")
    assert {r.face_id: r.part for r in zone_parts(table).collect()} == {r[1]: find(r[1]) for r in rows}
    if side == 3000:
        assert linked_boxes(table.withColumnRenamed("face_id", "id"), ["drawing_id"], Steps(spark)).distinct().count() < pairs / 3


def test_seeds_on_one_place_are_tested_once(spark):
    """More seeds on a place than a row carries, faces that touch and repeat; the ring test is compiled."""
    from tesselar.functions import geom as G
    from tesselar.plans.geometry import PACK, point_in_ring

    rng = random.Random(11)
    seeds = [(k, k % 2, rng.randrange(0, 6000, 500), rng.randrange(0, 6000, 500)) for k in range(400)] + [(1000 + k, 1, 2500, 2500) for k in range(2 * PACK + 1)]
    faces = [(d, k, x0, y0, x1, y1, "f") for d, k, x0, y0, x1, y1 in boxes(rng, 40, 5000, 2000)] + [(1, 900, 2000, 2000, 3000, 3000, "f"), (1, 901, 2000, 2000, 3000, 3000, "f"), (1, 902, 2500, 2000, 3000, 3000, "f")]
    want = sorted((s, f) for s, d, x, y in seeds for e, f, x0, y0, x1, y1, _ in faces if d == e and x0 < x < x1 and y0 < y < y1)
    found = point_in_ring(spark.createDataFrame(seeds, "seed_id long, drawing_id long, x long, y long"), spark.createDataFrame(faces, BOX.replace(" k ", " face_id ") + ", layer string"))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 4 * PACK
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    places = spark.createDataFrame([(float(x), float(y)) for x in range(-1, 5) for y in range(-1, 5)], "x double, y double")
    corners = [(0, 0), (3, 1), (4, 4), (2, 2), (0, 4)]
    lit = [(F.lit(float(x)), F.lit(float(y))) for x, y in corners]
    both = places.select(G.point_in_corners(F.col("x"), F.col("y"), lit).alias("a"), G.point_in_ring(F.col("x"), F.col("y"), F.array(*(G.point(*c) for c in lit))).alias("b"))
    assert all(r.a == r.b for r in both.collect()) and {r.a for r in both.collect()} == {True, False}
