import pytest

from tesselar.operators import overlay as O
from tesselar.operators import rings as R

CASES = {
    "square": ([(0, 0), (10, 0), (10, 10), (0, 10)], 100, 1),
    "clockwise": ([(0, 0), (0, 10), (10, 10), (10, 0)], 100, 1),
    "bow tie": ([(0, 0), (10, 10), (10, 0), (0, 10)], 25, 2),
    "uneven bow tie": ([(0, 0), (30, 30), (30, 0), (0, 15)], 300, 2),
    "repeated vertices": ([(0, 0), (0, 0), (10, 0), (10, 0), (10, 10), (0, 10), (0, 10), (0, 0)], 100, 1),
    "spike outwards": ([(0, 0), (10, 0), (10, 5), (20, 5), (10, 5), (10, 10), (0, 10)], 100, 1),
    "spike inwards": ([(0, 0), (10, 0), (10, 5), (4, 5), (10, 5), (10, 10), (0, 10)], 100, 1),
    "touches itself": ([(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)], 25, 2),
    "two loops": ([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (20, 20), (20, 40), (40, 40), (40, 20), (20, 20)], 400, 2),
    "loop in a loop": ([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (3, 3), (6, 3), (6, 6), (3, 6), (3, 3)], 91, 1),
    "pentagram": ([(0, 100), (58.779, -80.902), (-95.106, 30.902), (95.106, 30.902), (-58.779, -80.902)], None, 5),
    "cut through": ([(0, 0), (10, 0), (10, 10), (5, 10), (5, 0), (5, 10), (0, 10)], 100, 1),
    "on one line": ([(0, 0), (5, 0), (10, 0)], None, 0),
    "two points": ([(0, 0), (5, 5)], None, 0),
    "none": ([], None, 0),
}


def test_rings_of_all_kinds(spark):
    names = list(CASES)
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in CASES[n][0]]) for k, n in enumerate(names)] + [(99, None)]
    found, edges = R.repaired(spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>"))
    got = {names[r.id]: r for r in found.collect()}
    assert {n: got[n].parts if n in got else 0 for n in names} == {n: parts for n, (_, _, parts) in CASES.items()}
    assert {n: pytest.approx(got[n].area, abs=0.1) for n, (_, a, _) in CASES.items() if a} == {n: a for n, (_, a, _) in CASES.items() if a}
    # the edges that are kept enclose the same area, counter-clockwise
    own = {names[r.id]: r.area for r in O.polygon_areas(edges, "id").collect()}
    assert own == {n: pytest.approx(r.area, abs=1e-6) for n, r in got.items()}


def test_no_rings(spark):
    found, edges = R.repaired(spark.createDataFrame([], "id long, ring array<struct<x:double,y:double>>"))
    assert found.count() == 0 and edges.count() == 0
