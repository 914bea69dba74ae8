import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.operators import endpoints as E
from tesselar.operators import topology as T

SCHEMA = "drawing_id long, seg_id long, x1 long, y1 long, x2 long, y2 long, layer string"


def table(spark, rows):
    return spark.createDataFrame([(d, k, *map(int, r), layer) for k, (d, r, layer) in enumerate(rows)], SCHEMA)


def square(d, x, y, side, layer="WALL"):
    return [(d, (x, y, x + side, y), layer), (d, (x + side, y, x + side, y + side), layer), (d, (x, y + side, x + side, y + side), layer), (d, (x, y, x, y + side), layer)]


def lattice(d, m, n, step=100):
    return [(d, (0, j * step, m * step, j * step), "WALL") for j in range(n + 1)] + [(d, (i * step, 0, i * step, n * step), "WALL") for i in range(m + 1)]


def faces_of(spark, rows):
    found, outlines = T.polygonize(T.node_edges(table(spark, rows)))
    return found.collect(), outlines


def test_lattice_dangle_and_hole(spark):
    rows = lattice(1, 3, 2) + [(1, (300, 200, 400, 300), "WALL")] + square(2, 0, 0, 20_000) + square(2, 5000, 5000, 10_000)
    found, outlines = faces_of(spark, rows)
    one = [f for f in found if f.drawing_id == 1]
    assert len(one) == 6 and all(abs(f.area - 10_000) < 1e-6 and f.holes == 0 for f in one)
    two = sorted((f.area, f.holes, f.perimeter) for f in found if f.drawing_id == 2)
    assert [(a, h) for a, h, _ in two] == [(1e8, 0), (3e8, 1)]
    rings = {r.face: r.ring for r in T.face_rings(outlines).collect()}
    area = lambda ring: abs(sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert sorted(area(r) for r in rings.values()) == [10_000] * 6 + [1e8, 4e8]


def test_slanted_crossing(spark):
    found, _ = faces_of(spark, square(1, 0, 0, 100) + [(1, (0, 0, 100, 100), "WALL"), (1, (0, 100, 100, 0), "WALL")])
    assert len(found) == 4 and all(math.isclose(f.area, 2500, abs_tol=1e-3) for f in found)


def test_seed_in_inner_face_and_dissolve(spark):
    rows = square(2, 0, 0, 20_000) + square(2, 5000, 5000, 10_000)
    found, outlines = T.polygonize(T.node_edges(table(spark, rows)))
    seeds = spark.createDataFrame([(2, 1, 10_000.0, 10_000.0), (2, 2, 1000.0, 1000.0), (2, 3, 90_000.0, 0.0)], "drawing_id long, seed_id long, x double, y double")
    got = {r.seed_id: r.area for r in T.seeds_in_faces(seeds, found, outlines).collect()}
    assert got == {1: 1e8, 2: 3e8}
    found, outlines = T.polygonize(T.node_edges(table(spark, lattice(1, 3, 2))))
    edges = T.dissolve_edges(outlines, found.select("drawing_id", "face", F.lit(1).alias("grp"))).collect()
    assert len(edges) == 10


@pytest.mark.parametrize(
    "segments,tier2,bridges,length",
    [
        ([(0, 0, 100, 0), (100, 0, 200, 0), (350, 0, 450, 0), (202, 0, 202, 30)], None, 3, 150),
        ([(0, 0, 0, 100), (0, 100, 0, 200), (0, 380, 0, 480)], None, 2, 180),
        ([(0, 0, 0, 3), (3, 0, 3, 3), (0, 3, 10, 3), (3, 0, 10, 0)], None, 2, None),
        ([(0, 0, 1000, 0), (1745, 0, 3000, 0)], None, 0, None),
        ([(0, 0, 1000, 0), (1745, 0, 3000, 0)], 800.0, 1, 745),
    ],
)
def test_bridges(spark, segments, tier2, bridges, length):
    rows = table(spark, [(1, s, "S-FNDN-1") for s in segments])
    got = T.close_gaps(rows, 500.0, tier2).collect()
    assert len(got) == bridges and (length is None or length in {r.distance for r in got})
    ends = [(r.ax, r.ay) for r in got] + [(r.bx, r.by) for r in got]
    assert len(ends) == len(set(ends))


def test_far_gap_to_detail_layer_stays_open(spark):
    rows = table(spark, [(1, (0, 0, 1000, 0), "S-FNDN-1"), (1, (1600, 0, 3000, 0), "A-DETL-1")])
    assert not T.close_gaps(rows, 500.0, 800.0).collect()


def test_snap_moves_to_the_mean_with_multiplicity(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 0.0, "W"), (1, 2, 100.9, 0.0, 200.0, 0.0, "W"), (1, 3, 100.0, 0.0, 100.0, 50.0, "W")], "drawing_id long, seg_id long, x1 double, y1 double, x2 double, y2 double, layer string")
    got = {r.seg_id: r for r in T.snap_endpoints(df, 1.0).collect()}
    assert got[1].x2 == got[2].x1 == got[3].x1 == pytest.approx(100.3)


def test_iteration_ends_and_history(spark):
    rows = table(spark, [(1, (0, 0, 1000, 0), "WALL"), (1, (1150, 0, 2000, 0), "WALL")])
    closed, history = T.iterative_close(rows)
    assert closed.where("layer = 'GAP_BRIDGE'").count() >= 1
    assert [r.closed for r in history.orderBy("pass").collect()][0] >= 1


def test_ring_functions(spark):
    ring = [(0.0, 0.0), (10_000.0, 0.0), (10_000.0, 10_000.0), (0.0, 10_000.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
    r = df.select(G.ring_area(F.col("ring"), 0.001).alias("a"), G.ring_perimeter(F.col("ring"), 0.001).alias("p"), G.volume(G.ring_area(F.col("ring"), 0.001), 0.15).alias("v"), G.ring_centroid(F.col("ring")).alias("c"), G.ring_validity(F.col("ring")).alias("ok")).first()
    assert (r.a, r.p, round(r.v, 9), r.c.x, r.c.y, r.ok) == (100.0, 40.0, 15.0, 5000.0, 5000.0, True)


def test_free_ends(spark):
    rows = table(spark, square(1, 0, 0, 100) + [(1, (100, 100, 200, 200), "WALL")])
    assert [(r.x, r.y) for r in E.free_ends(rows).collect()] == [(200, 200)]


def test_slab_outline_is_the_union_of_large_faces(spark):
    """Two large squares side by side and a small one apart; a drawing of loose lines has its hull."""
    rows = square(1, 0, 0, 20_000) + square(1, 20_000, 0, 20_000) + square(1, 60_000, 0, 1000) + square(2, 0, 0, 12_000)
    rows += [(3, (0, 0, 5000, 0), "WALL"), (3, (0, 8000, 5000, 8000), "WALL")]
    got = {r.drawing_id: (r.method, round(r.area), round(r.perimeter)) for r in T.slab_outlines(table(spark, rows)).collect()}
    assert got == {1: ("polygonize_union", 800_000_000, 120_000), 2: ("polygonize", 144_000_000, 48_000), 3: ("convex_hull", 40_000_000, 26_000)}


def test_long_chains_of_dangles_go_at_once(spark):
    rows = square(1, 0, 0, 1000) + [(1, (1000 + 100 * k, 1000, 1100 + 100 * k, 1000), "WALL") for k in range(40)] + square(1, 5000, 1000, 500)
    found, outlines = faces_of(spark, rows)
    assert sorted(f.area for f in found) == [250_000.0, 1_000_000.0] and outlines.count() == 8


def plain_faces(edges):
    """Faces of one drawing by walking: rings of corners (counter-clockwise), holes taken off the smallest ring around them."""
    out = {}
    for ux, uy, vx, vy in edges:
        out.setdefault((ux, uy), []).append((vx, vy))
        out.setdefault((vx, vy), []).append((ux, uy))
    while True:
        lone = [p for p, q in out.items() if len(q) == 1]
        if not lone:
            break
        for p in lone:
            if out.get(p):
                q = out[p][0]
                out[q].remove(p)
                del out[p]
                if not out[q]:
                    del out[q]
    for p, q in out.items():
        q.sort(key=lambda v: math.atan2(v[1] - p[1], v[0] - p[0]))
    seen, rings = set(), []
    for p in out:
        for q in out[p]:
            ring, a, b = [], p, q
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(a)
                turn = out[b]
                a, b = b, turn[turn.index(a) - 1]
            if ring:
                rings.append(ring)
    area = lambda r: sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1], strict=True)) / 2
    shells = [(area(r), r) for r in rings if area(r) > 0]
    net = {k: a for k, (a, _) in enumerate(shells)}

    def holds(ring, x, y):
        return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    for r in rings:
        if area(r) < 0:
            x, y = min(r)
            around = [(a, k) for k, (a, s) in enumerate(shells) if (x, y) not in s and holds(s, x, y)]
            if around:
                net[min(around)[1]] += area(r)
    return [(net[k], ring) for k, (_, ring) in enumerate(shells)], holds


def test_faces_against_plain_walking(spark):
    from tesselar.plans import registry, topology
    from tesselar.plans.fixtures import load

    sf = "/root/testdata/sf0.001"
    queries = registry.queries()
    edges = {}
    for r in T.node_edges(topology.plan(load(spark, sf, "faces"))).collect():
        edges.setdefault(r.drawing_id, []).append((r.ux / 1000, r.uy / 1000, r.vx / 1000, r.vy / 1000))
    want = {d: plain_faces(e) for d, e in edges.items()}
    found = {}
    for r in queries["polygonize"](spark, sf).collect():
        found.setdefault(r.drawing_id, []).append(r.area)
    assert {d: sorted(round(a, 2) for a, _ in f) for d, (f, _) in want.items()} == {d: sorted(a) for d, a in found.items()}
    for r in queries["detect_from_tagged"](spark, sf).collect():
        own = [a for a, _ in want[r.drawing_id][0]]
        assert (r.faces, r.small) == (len(own), sum(a < 1e6 for a in own)) and abs(r.area_m2 - sum(own) * 1e-6) < 0.001
    large = {d: sum(a >= 1e6 for a, _ in f) for d, (f, _) in want.items()}
    counts = {}
    for r in queries["detect_regions"](spark, sf).collect():
        counts[r.drawing_id] = max(counts.get(r.drawing_id, 0), r.region)
    assert counts == {d: n for d, n in large.items() if n}
    assert queries["compute_regions"](spark, sf).count() == sum(len(f) for f, _ in want.values())
    total = {r.drawing_id: r.area for r in queries["dissolve"](spark, sf).collect()}
    assert all(abs(total[d] - sum(a for a, _ in f)) < 1 for d, (f, _) in want.items())


def test_rings_close_in_tasks(spark, monkeypatch):
    """Ways of any deal to tasks: random rings cut into pieces; on a lattice the rounds of joins have rings across tiles only."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        h = rng.permutation(10 * n)[:n].astype(np.int64)
        following = h[rng.permutation(n)]
        ahead = dict(zip(h.tolist(), following.tolist(), strict=True))
        own = rng.random(n) < rng.choice([0.5, 0.9, 1.0])
        mine = set(h[own].tolist())
        low, end, first = T.followed(h[own], following[own])
        for k, (a, lo, e, f) in enumerate(zip(h[own].tolist(), low.tolist(), end.tolist(), first.tolist(), strict=True)):
            way, b = [a], ahead[a]
            while b in mine and b != a:
                way.append(b)
                b = ahead[b]
            assert lo == min(way)
            assert (e == -1) if b == a else (h[own][e] == way[-1])
            assert f == (b != a and a not in {ahead[x] for x in mine})
    counts = []
    count = T.Steps.cut_and_count

    def counted(self, df, condition):
        out, n = count(self, df, condition)
        counts.append(out.count())
        return out, n

    monkeypatch.setattr(T.Steps, "cut_and_count", counted)
    for at_once, tile in ((1_000_000, T.TILE), (64, 700 * T.SCALE)):
        monkeypatch.setattr(T, "AT_ONCE", at_once)
        monkeypatch.setattr(T, "TILE", tile)
        counts.clear()
        found, _ = faces_of(spark, lattice(1, 30, 30) + square(2, 0, 0, 20_000) + square(2, 5000, 5000, 10_000))
        assert sorted(round(f.area) for f in found) == [10_000] * 900 + [100_000_000, 300_000_000]
        if at_once > 64:
            assert max(counts) < 60  # of 3,736 half-edges
