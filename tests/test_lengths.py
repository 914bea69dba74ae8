import random

import numpy as np
import pytest

from tesselar.operators.lengths import below
from tesselar.plans.joins import polygon_layer_overlap

LINE = "drawing_id long, seg_id long, x1 long, y1 long, x2 long, y2 long, layer string"
FACE = "drawing_id long, face_id long, x0 long, y0 long, x1 long, y1 long, layer string"


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_sums_of_the_first_values_below_a_bound(n):
    rng = np.random.default_rng(n)
    values, ranks, bounds = rng.integers(0, 20, n), rng.integers(0, n + 1, 300), rng.integers(-2, 23, 300)
    for side in ("left", "right"):
        count, total = below(values, ranks, bounds, side)
        own = [[v for v in values[:r] if v < x or (side == "right" and v == x)] for r, x in zip(ranks, bounds, strict=True)]
        assert count.tolist() == [len(o) for o in own] and total.tolist() == [sum(o) for o in own]


@pytest.mark.parametrize("slanted", [False, True])
def test_layer_with_most_length_against_all_pairs(spark, slanted):
    """Lines that end on, touch, cross, lie in or repeat one another, over several strips; slanted ones by their boxes, as the SQL has it. No pair is joined unless there are such."""
    rng = random.Random(3)
    lines = []
    for k in range(400):
        x, y, n = rng.randrange(0, 9000, 100), rng.randrange(0, 9000, 100), rng.choice([0, 100, 700, 5000])
        w, h = (n, rng.choice([100, 300])) if slanted and k % 5 == 0 else rng.choice([(n, 0), (0, n)])
        lines.append((k % 2, k, x, y, x + w, y + h, rng.choice(["a", "b", "c", None])))
    faces = [(k % 3, k, x := rng.randrange(-500, 9000, 100), y := rng.randrange(-500, 9000, 100), x + rng.choice([0, 100, 6000]), y + rng.choice([0, 300, 6000]), "f") for k in range(120)]
    want = {}
    for d, f, x0, y0, x1, y1, _ in faces:
        by = {}
        for e, _, p, q, r, t, layer in lines:
            if d == e and p <= x1 and x0 <= r and q <= y1 and y0 <= t:
                by[layer] = by.get(layer, 0) + min(x1, r) - max(x0, p) + min(y1, t) - max(y0, q)
        if by:
            want[f] = min(by.items(), key=lambda i: (-i[1], i[0] is not None, i[0]))
    found = polygon_layer_overlap(spark.createDataFrame(faces, FACE), spark.createDataFrame(lines, LINE))
    assert {r.face_id: (r.layer, r.length) for r in found.collect()} == want and len(want) > 50
    assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == slanted
