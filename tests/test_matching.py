import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.functions import review as R
from tesselar.operators import gaps as P
from tesselar.operators import matching as M
from tesselar.plans import registry
from tests.test_topology import table

SF = "/root/testdata/sf0.001"


def every_matching(edges):
    """Most pairs, most profiles, least cost over all sets of edges."""
    best = (0, 0, 0.0)
    for n in range(len(edges) + 1):
        for chosen in itertools.combinations(edges, n):
            ends = [e for a, b, _, _ in chosen for e in (a, b)]
            if len(ends) == len(set(ends)):
                best = max(best, (n, sum(p for _, _, p, _ in chosen), round(-sum(c for _, _, _, c in chosen), 6)))
    return best


def test_small_groups_are_matched_best():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 7)
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.5][:9]
        edges = [(a, b, rng.random() < 0.2, round(rng.random() * 100, 3)) for a, b in pairs]
        chosen = [edges[k] for k in M.best_matching(edges, n)]
        ends = [e for a, b, _, _ in chosen for e in (a, b)]
        assert len(ends) == len(set(ends))
        assert (len(chosen), sum(p for _, _, p, _ in chosen), round(-sum(c for _, _, _, c in chosen), 6)) == every_matching(edges)


def most_pairs(n, edges, p=2_147_483_629):
    """Half the rank of a skew matrix with a random value for each edge: the pairs of a maximum matching, but for odds of n in p."""
    rng = random.Random(5)
    a = np.zeros((n, n), np.int64)
    for i, j, *_ in edges:
        v = rng.randrange(1, p)
        a[i, j], a[j, i] = v, p - v
    rank = 0
    for c in range(n):
        at = np.flatnonzero(a[rank:, c])
        if not len(at):
            continue
        a[[rank, rank + at[0]]] = a[[rank + at[0], rank]]
        inverse = pow(int(a[rank, c]), -1, p)
        a[rank] = [int(x) * inverse % p for x in a[rank]]
        below = rank + 1 + np.flatnonzero(a[rank + 1 :, c])
        a[below] = (a[below] - a[below, c][:, None] * a[rank][None, :] % p) % p
        rank += 1
    return rank // 2


def scattered(seed, n, width, height, reach=500.0):
    """Ends at random whole places, and all candidates within the reach."""
    rng = random.Random(seed)
    points = sorted({(rng.randrange(width), rng.randrange(height)) for _ in range(n)})
    edges = []
    for i, (x, y) in enumerate(points):
        for j in range(i + 1, len(points)):
            if points[j][0] - x > reach:
                break
            d = ((points[j][0] - x) ** 2 + (points[j][1] - y) ** 2) ** 0.5
            if d <= reach:
                edges.append((i, j, rng.random() < 0.1, d))
    return points, edges


def test_large_groups_get_the_most_pairs():
    rng = random.Random(1)
    for n, degree in itertools.product((13, 20, 41, 80, 150), (1.2, 2, 3)):
        for _ in range(3):
            edges = [(i, j, rng.random() < 0.1, rng.random() * 100) for i, j in itertools.combinations(range(n), 2) if rng.random() < degree / n]
            ends = [e for k in M.solve_group(edges, n) for e in edges[k][:2]]
            assert len(ends) == len(set(ends)) == 2 * most_pairs(n, edges)
    points, edges = scattered(4, 600, 9000, 9000)
    assert len(M.solve_group(edges, len(points))) == most_pairs(len(points), edges)


def test_odd_cycles_in_odd_cycles():
    """Two triangles and a pentagon in a row: paths lead through each of them."""
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 3), (5, 8), (8, 9), (9, 10), (10, 8), (10, 11), (1, 12), (6, 13)]
    for seed in range(20):
        rng = random.Random(seed)
        names = rng.sample(range(14), 14)
        own = [(names[a], names[b], False, rng.random()) for a, b in edges]
        assert len(M.solve_group(own, 14)) == most_pairs(14, own) == 7


def test_exchanges_come_close_to_the_best(monkeypatch):
    """Groups of up to 12 ends, once by weighing all matchings and once as large groups are matched."""
    got = want = 0.0
    for seed in range(120):
        points, edges = scattered(seed, 12, 900, 900)
        value = lambda chosen: (len(chosen), sum(edges[k][2] for k in chosen), sum(edges[k][3] for k in chosen))  # noqa: B023, E731
        monkeypatch.setattr(M, "EXACT", 12)
        best = value(M.solve_group(edges, len(points)))
        monkeypatch.setattr(M, "EXACT", 0)
        own = value(M.solve_group(edges, len(points)))
        assert own[0] == best[0] and own[1] <= best[1]
        got, want = got + own[2], want + best[2]
    assert got <= 1.005 * want


def as_candidates(spark, points, edges):
    rows = [(d, *points[i], *points[j], c, c, p, c < 15) for d in (1, 2) for i, j, p, c in edges]
    return spark.createDataFrame(rows, "drawing_id long, ax long, ay long, bx long, by long, distance double, cost double, profile boolean, micro boolean").repartition(5)


def test_groups_over_tiles(spark):
    """Points that several tasks see tie their groups."""
    from tesselar.operators.graph import linked_groups
    from tesselar.operators.state import Steps

    df = as_candidates(spark, *scattered(9, 500, 12_000, 9000)).cache()
    got = {}
    for r in linked_groups(df, Steps(spark), tile=700).collect():
        got.setdefault((r.drawing_id, r.gx, r.gy), set()).add((r.ax, r.ay, r.bx, r.by))
    want = {}
    for g in groups(df.collect()):
        ends = [(r.drawing_id, x, y) for r in g for x, y in ((r.ax, r.ay), (r.bx, r.by))]
        want[min(ends)] = {(r.ax, r.ay, r.bx, r.by) for r in g}
    assert got == want and len(got) > 20


def test_groups_too_large_for_a_task(spark):
    """Tiles in four positions: pairs are disjoint, and hardly fewer than in one piece; phases give what they give in one piece."""
    points, edges = scattered(6, 900, 9000, 9000)
    df = as_candidates(spark, points, edges).cache()
    most = most_pairs(len(points), edges)
    whole = M.match_general(df).collect()
    tiles = M.match_general(df, largest=300).collect()
    assert len(whole) == 2 * most and 2 * most * 0.99 <= len(tiles) <= 2 * most
    for rows in (tiles, M.match_adopt(df, largest=300).collect()):
        ends = [(r.drawing_id, x, y) for r in rows for x, y in ((r.ax, r.ay), (r.bx, r.by))]
        assert len(ends) == len(set(ends))
    phased = M.match_adopt(df).collect()
    assert len(phased) >= 0.95 * len(whole)
    assert M.match_general(df.limit(0)).count() == 0 and M.match_adopt(df.limit(0)).count() == 0


def test_tiles_start_from_earlier_pairs(spark, monkeypatch):
    """Later tiles follow what they have anew: all but the first round start from the pairs chosen before, and ask few ends again."""
    from tesselar.operators.state import Steps

    points, edges = scattered(6, 900, 9000, 9000)
    df = as_candidates(spark, points, edges).where("drawing_id = 1").cache()
    pairs = {(r.ax, r.ay, r.bx, r.by) for r in M.tiled(df.select(*M.COLUMNS), 300, Steps(spark)).collect()}
    place = {p: k for k, p in enumerate(points)}
    ends = [place[e] for p in pairs for e in (p[:2], p[2:])]
    assert len(ends) == len(set(ends)) and len(pairs) >= 0.99 * most_pairs(len(points), edges)
    # a matching that is as good as exchanges make it is kept, and no end is asked again
    whole = [edges[k] for k in M.solve_group(edges, len(points))]
    asked = []
    exchange = M.Graph._exchange
    monkeypatch.setattr(M.Graph, "_exchange", lambda self, u, depth: asked.append(u) or exchange(self, u, depth))
    again = [edges[k] for k in M.solve_group(edges, len(points), start=[e[:2] for e in whole], fresh=[])]
    assert sorted(again) == sorted(whole) and not asked


def test_dense_groups_are_matched_by_their_cheapest_candidates(spark, monkeypatch):
    """Some thirty candidates for each end: tiles see few of them, and all of them only around ends that are still free."""
    points, edges = scattered(6, 900, 3400, 3400)
    df = as_candidates(spark, points, edges).where("drawing_id = 1").cache()
    seen = []
    by_group = M._by_group

    def counted(rows, *a):
        if "kind" in rows.columns:
            seen.append(rows.where("kind = 0").count())
        return by_group(rows, *a)

    monkeypatch.setattr(M, "_by_group", counted)
    whole, tiles = M.match_general(df).collect(), M.match_general(df, largest=4000).collect()
    ends = [(x, y) for r in tiles for x, y in ((r.ax, r.ay), (r.bx, r.by))]
    assert len(ends) == len(set(ends)) and len(tiles) >= 0.99 * len(whole) and len(edges) > 20 * len(points) / 2
    assert seen and max(seen[:4]) < 0.6 * len(edges)
    assert sum(r.cost for r in tiles) <= 1.05 * sum(r.cost for r in whole)


def test_most_pairs_before_least_cost(spark):
    """A cheap pair in the middle would leave both outer ends alone."""
    rows = [(1, p, 0, q, 0, float(q - p), float(q - p), False) for p, q in ((0, 100), (100, 110), (110, 210))]
    df = spark.createDataFrame(rows, "drawing_id long, ax long, ay long, bx long, by long, distance double, cost double, profile boolean")
    assert sorted((r.ax, r.bx) for r in M.match_general(df).collect()) == [(0, 100), (110, 210)]
    assert sorted((r.ax, r.bx) for r in M.mutual_pairs(df).collect()) == [(100, 110)]


def groups(candidates):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for c in candidates:
        root[find((c.drawing_id, c.ax, c.ay))] = find((c.drawing_id, c.bx, c.by))
    out = {}
    for c in candidates:
        out.setdefault(find((c.drawing_id, c.ax, c.ay)), []).append(c)
    return list(out.values())


def test_bridges_of_the_plan(spark):
    """Matching, closing and what follows, against all matchings of each small group."""
    from tesselar.operators import endpoints as E
    from tesselar.plans.fixtures import load

    candidates = E.gap_candidates(load(spark, SF, "segments"), 500.0).collect()
    by_name = {n: registry.queries()[n](spark, SF).collect() for n in ("match_general", "match_adopt", "close_gaps", "tagged_close")}
    pair = lambda r: (r.drawing_id, r.ax, r.ay, r.bx, r.by)
    chosen = {n: {pair(r) for r in rows} for n, rows in by_name.items() if n != "tagged_close"}
    every = {pair(c): c for c in candidates}
    for rows in chosen.values():
        assert rows <= set(every)
        ends = [(d, *e) for d, ax, ay, bx, by in rows for e in ((ax, ay), (bx, by))]
        assert len(ends) == len(set(ends))
    small = [g for g in groups(candidates) if len(g) <= 9]
    assert small
    for g in small:
        want = every_matching([((c.ax, c.ay), (c.bx, c.by), c.profile, c.cost) for c in g])
        own = [c for c in g if pair(c) in chosen["match_general"]]
        assert (len(own), sum(c.profile for c in own), round(-sum(c.cost for c in own), 6)) == pytest.approx(want)
    count = lambda n: {d: sum(r[0] == d for r in chosen[n]) for d in {r[0] for r in every}}
    assert all(count("match_adopt")[d] >= k for d, k in count("match_general").items())
    assert chosen["close_gaps"] == chosen["match_adopt"]
    assert {(r.drawing_id, r.x1, r.y1, r.x2, r.y2) for r in by_name["tagged_close"]} == chosen["close_gaps"] and {r.layer for r in by_name["tagged_close"]} == {"GAP_BRIDGE"}


def test_far_tier_adds_only_structural_pairs(spark):
    far = [r for r in registry.queries()["close_gaps_tier2"](spark, SF).collect() if r.distance > 500]
    assert all(r.distance <= 800 for r in far)
    ends = [(r.drawing_id, x, y) for r in far for x, y in ((r.ax, r.ay), (r.bx, r.by))]
    assert len(ends) == len(set(ends))


def test_passes_end_and_add_up(spark):
    passes = registry.queries()["closure_history"](spark, SF).collect()
    total = {r.drawing_id: 0 for r in passes}
    for r in passes:
        assert r.free_after <= r.free_before and 1 <= r["pass"] <= 3
        total[r.drawing_id] += r.closed
    bridges = {r.drawing_id: r.n for r in registry.queries()["iterative_close"](spark, SF).where("layer = 'GAP_BRIDGE'").collect()}
    assert all(bridges.get(d, 0) >= (n > 0) for d, n in total.items())


def test_outlines(spark):
    slab = {r.drawing_id: r for r in registry.queries()["slab_outline"](spark, SF).collect()}
    auto = {r.drawing_id: r for r in registry.queries()["auto_boundary"](spark, SF).collect()}
    assert {d: (r.area, r.perimeter) for d, r in slab.items()} == {d: (r.area, r.perimeter) for d, r in auto.items()}
    assert all(r.area > 0 and r.perimeter**2 >= 12.5 * r.area for r in slab.values())  # no outline is better than a circle


def test_gaps_between_far_ends(spark):
    """Ends 700, 3000 and 40,000 apart: by status, and an orphan beyond the reach. The nearest end has no limit."""
    from tesselar.operators import endpoints as E

    rows = table(spark, [(1, (0, 0, 1000, 0), "A"), (1, (1700, 0, 5000, 0), "A"), (1, (8000, 0, 9000, 0), "B"), (1, (60_000, 0, 61_000, 0), "B"), (2, (0, 0, 10, 0), "A")])
    got = {(r.ax, r.bx): r.status for r in P._gaps(rows, 500.0).where("drawing_id = 1").collect()}
    assert got == {(1000, 1700): "above_threshold_close", (5000, 8000): "large_gap_manual_review", (0, 9000): "large_gap_manual_review", (60_000, None): "orphan_endpoint", (61_000, None): "orphan_endpoint"}
    near = {(r.drawing_id, r.x): r.d2 for r in E.nearest_other(E.free_ends(rows)).collect()}
    assert near[(1, 60_000)] == 51_000**2 and near[(2, 0)] is None


@pytest.mark.parametrize(
    "distance,delta,cost,micro",
    [
        (150, 180, 0.01, False), (178, 176, 0.01, False), (150, 0, 52.5, False), (150, 60, 52.5, False), (150, None, 52.5, False), (100, 35, 85.0, False), (100, 36, 100.0, False),
        (100, 90, 85.0, False), (100, 76, 75.0, False), (100, 178, 85.0, False), (100, 75, 100.0, False), (15, 35, 12.75, True), (15, 36, 15.0, False), (15, 95, 12.75, True), (15, None, 15.0, True), (16, 0, 13.6, False),
    ],
)
def test_bridge_rules(spark, distance, delta, cost, micro):
    df = spark.createDataFrame([(float(distance), None if delta is None else float(delta))], "d double, a double")
    r = df.select(G.bridge_cost(F.col("d"), F.col("a")).alias("c"), G.is_micro_gap(F.col("d"), F.col("a")).alias("m")).first()
    assert (r.c, r.m) == (pytest.approx(cost), micro)


def test_layer_rules(spark):
    pairs = {("S-FNDN-1", "s-fndn-1"): True, ("S-BEAM-2", "A-WALL-3"): True, ("S-FNDN-1", "A-WALL"): True, ("A-WALL", "A-WALL-2"): False, ("WALL", "WALL"): False, ("A-DETL-1", "A-DETL-1"): False, ("S-FNDN-2", "S-BEAM-1"): False, (None, "A-WALL"): False}
    df = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", R.tier2_layer_pair(F.col("a"), F.col("b")).alias("got")).collect())
    hints = {"S-GRID-1": True, "AXIS": True, "ANNO-X": False, "my_no_plot": True, "dim2": True, "A-WALL": False}
    df = spark.createDataFrame(list(hints.items()), "a string, want boolean")
    assert all(r.got == r.want for r in df.select("want", R.annotation_layer(F.col("a")).alias("got")).collect())


def test_names_match_by_parts(spark):
    from tesselar.sources.documents import match_drawings

    seeds = spark.createDataFrame([("plan-1",), ("PLAN-12.dxf",), ("other",), (None,)], "seed_drawing string")
    drawings = spark.createDataFrame([("Plan-1.DXF",), ("plan-12.dxf",)], "drawing string")
    got = {(r.seed_drawing, r.drawing) for r in match_drawings(seeds, drawings).collect()}
    assert got == {("plan-1", "Plan-1.DXF"), ("plan-1", "plan-12.dxf"), ("PLAN-12.dxf", "plan-12.dxf"), (None, "Plan-1.DXF"), (None, "plan-12.dxf")}


def test_grid_target_takes_the_first_of_equals(spark):
    from tesselar.operators.grid import axis_target

    df = spark.createDataFrame([(1, 7, 5), (2, 13, 13), (3, 2, 2)], "drawing_id long, nx long, ny long")
    got = {r.drawing_id: (r.columns, r.rows, r.mode) for r in axis_target(df, 24).collect()}
    assert got == {1: (6, 4, "target_24"), 2: (4, 6, "target_24"), 3: (1, 1, "raw_unmatched_target")}


def test_zones_count_overlaps_once(spark):
    """Two faces that overlap by half, one apart: the larger part is the zone's area; slivers stay out."""
    from tesselar.operators.zones import zones

    faces = spark.createDataFrame([(1, 1, 0, 0, 2000, 2000), (2, 1, 1000, 0, 3000, 2000), (3, 1, 5000, 5000, 6000, 6100), (4, 1, 0, 0, 900, 900)], "face_id long, drawing_id long, x0 long, y0 long, x1 long, y1 long")
    bays = spark.createDataFrame([(1, 0, 0, 10_000, 10_000)], "bay_id long, x0 long, y0 long, x1 long, y1 long")
    (r,) = zones(faces, bays)[0].collect()
    assert (r.face_ids, r.faces, r.face_sum, r.area) == ([1, 2, 3], 3, 9_100_000, 6_000_000)


@pytest.mark.parametrize("few", [2, 32])
def test_union_of_many_boxes(spark, few):
    """Dense and sparse keys, copies, whole and broken coordinates, against a raster; boxes without area count nothing."""
    from tesselar.operators.zones import union_area

    rng = random.Random(12)
    rows = []
    for key, n, most in ((1, 150, 60), (2, 4, 200), (3, 300, 20)):
        for _ in range(n):
            x, y = rng.randrange(200), rng.randrange(200)
            rows.append((key, x, y, x + rng.randrange(most), y + rng.randrange(most)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k long, x0 long, y0 long, x1 long, y1 long")
    raster = {}
    for k, x0, y0, x1, y1 in rows:
        raster.setdefault(k, np.zeros((500, 500), bool))[x0:x1, y0:y1] = True
    for scale in (1, 0.25):
        scaled = df.select("k", *((F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")))
        got = {r.k: r.area for r in union_area(scaled, ["k"], side=64, few=few).collect()}
        assert got == {k: int(m.sum()) * scale * scale for k, m in raster.items()}
    assert union_area(df.limit(0), ["k"]).count() == 0


def test_dense_boxes_stay_in_proportion(spark, monkeypatch):
    """Twenty boxes over every point: all levels together have some rows for each box, not one for each pair."""
    from tesselar.operators import zones as Z

    seen = []
    cut = Z.Steps.cut

    def counted(self, df):
        out = cut(self, df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(Z.Steps, "cut", counted)
    n = 16_000
    rng = random.Random(5)
    rows = [(1, x, y, x + 40 + rng.randrange(200), y + 40 + rng.randrange(200)) for x, y in ((rng.randrange(4000), rng.randrange(4000)) for _ in range(n))]
    Z.union_area(spark.createDataFrame(rows, "k long, x0 long, y0 long, x1 long, y1 long"), ["k"], side=512).collect()
    assert sum(seen) < 40 * n
