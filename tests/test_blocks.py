import pytest

from tesselar.operators import blocks as B

INSERTS = "insert_id long, block string, x double, y double, scale double, angle double"
ENTITIES = "block string, entity int, closed boolean, vertices array<struct<x:double,y:double>>"
NESTED = "block string, child string, x double, y double, scale double, angle double"


def tables(spark, inserts, entities, nested):
    points = lambda v: [{"x": float(x), "y": float(y)} for x, y in v]
    return (
        spark.createDataFrame([(k, b, *map(float, r)) for k, b, *r in inserts], INSERTS),
        spark.createDataFrame([(b, k, c, points(v)) for b, k, c, v in entities], ENTITIES),
        spark.createDataFrame([(b, c, *map(float, r)) for b, c, *r in nested], NESTED),
    )


def test_blocks_in_blocks_compose_turns_scales_and_shifts(spark):
    got = B.expand(*tables(
        spark,
        [(1, "A", 100, 0, 2, 90), (2, "C", 5, 5, 1, 45), (3, "none", 0, 0, 1, 0)],
        [("B", 0, False, [(0, 0), (1, 0)]), ("C", 0, False, [(1, 0), (2, 0)])],
        [("A", "B", 10, 0, 3, 90), ("B", "C", 0, 1, 1, -90)],
    )).collect()
    points = {(r.insert_id, r.block, r.depth): [(round(p.x, 6) + 0.0, round(p.y, 6) + 0.0) for p in r.vertices] for r in got}
    # B in A: three times as large, turned, at (10, 0); then all twice as large, turned, at (100, 0)
    assert points[1, "B", 1] == [(100, 20), (94, 20)]
    # C in B at (0, 1), turned back: (1, 0) -> (0, -1) + (0, 1) = (0, 0) in B, (2, 0) -> (0, -1) in B -> (13, 0) in A
    assert points[1, "C", 2] == [(100, 20), (100, 26)]
    assert points[2, "C", 0] == [(5.707107, 5.707107), (6.414214, 6.414214)]
    assert len(points) == 3


def test_blocks_that_hold_themselves(spark):
    got = B.expand(*tables(spark, [(1, "A", 0, 0, 1, 0)], [("A", 0, False, [(0, 0), (1, 1)]), ("B", 0, False, [(0, 0), (1, 1)])], [("A", "A", 1, 0, 1, 0), ("A", "B", 1, 0, 1, 0), ("B", "A", 1, 0, 1, 0)])).collect()
    assert sorted((r.block, r.depth) for r in got) == [("A", 0), ("B", 1)]


def test_footprints(spark):
    square = lambda s: [(0, 0), (s, 0), (s, s), (0, s)]
    sides = [((0, 0), (4, 0)), ((4, 0), (4, 4)), ((4, 4), (0, 4)), ((0, 4), (0, 0)), ((0, 3), (4, 3))]
    entities = [("ring", 0, True, square(10)), ("ring", 1, True, square(5)), ("ring", 2, False, [(0, 0), (1, 0)])]
    entities += [("lines", k, False, s) for k, s in enumerate(sides)] + [("corner", 0, False, [(0, 0), (6, 0), (6, 2)]), ("flat", 0, False, [(0, 0), (3, 0), (9, 0)])]
    inserts = [(k, b, 100 * k, 50, 2, a) for k, (b, a) in enumerate([("ring", 0), ("lines", 30), ("corner", 0), ("flat", 0), ("none", 0), ("outer", 0)])]
    got = {r.insert_id: r for r in B.footprints(*tables(spark, inserts, entities, [("outer", "ring", 7, 7, 3, 0)])).collect()}
    assert {k: (r.source, pytest.approx(r.area, rel=1e-3)) for k, r in got.items()} == {0: ("closed", 100), 1: ("traced", 16), 2: ("hull", 24), 3: ("placeholder", 160_000), 4: ("placeholder", 160_000), 5: ("closed", 900)}
    assert sorted((p.x, p.y) for p in got[5].ring) == [(514, 64), (514, 94), (544, 64), (544, 94)]
    assert len(got[1].ring) == 4


def test_no_inserts(spark):
    none = tables(spark, [], [], [])
    assert B.expand(*none).count() == 0 and B.footprints(*none).count() == 0
