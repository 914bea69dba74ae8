"""Planar topology on edge tables: noding, faces with holes, dissolve, gap closing.

Points are integer keys (``SCALE`` to a drawing unit), so joins never compare floating point. Iterated steps write their rows
to the shared folder; each loop runs over all drawings at once and ends when none changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.operators import endpoints as E
from tesselar.operators.cells import boxes_meet, points_in_boxes, renamed
from tesselar.operators.graph import components
from tesselar.operators.lattice import Traced
from tesselar.operators.matching import KEY, match_adopt, not_crossing
from tesselar.operators.overlay import crossings
from tesselar.operators.state import Steps

SCALE = 1000


# ---- hulls -------------------------------------------------------------------------------------


def convex_hulls(points: DataFrame) -> DataFrame:
    """drawing_id and the ring of its points' hull (monotone chain): hulls of parts first, then the hull of their corners."""
    low = points.groupBy("drawing_id", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("part", F.pmod(F.xxhash64("y"), F.lit(32)))
    schema = "drawing_id long, ring array<struct<x:double,y:double>>"
    parts = low.groupBy("drawing_id", "part").applyInPandas(_hull, schema).select("drawing_id", F.explode("ring").alias("p"))
    corners = parts.select("drawing_id", F.col("p.y").alias("y"), F.col("p.x").alias("a"), F.col("p.x").alias("b"))
    return corners.groupBy("drawing_id").applyInPandas(_hull, schema)


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    pts = sorted({(float(x), float(y)) for x, y in [*zip(pdf["a"], pdf["y"], strict=True), *zip(pdf["b"], pdf["y"], strict=True)]})

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(pts) + chain(pts[::-1]) if len(pts) > 2 else pts
    return pd.DataFrame({"drawing_id": [pdf["drawing_id"].iloc[0]], "ring": [[{"x": x, "y": y} for x, y in ring]]})


# ---- noding -----------------------------------------------------------------------------------


def node_edges(segments: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Undirected edges drawing_id, ux, uy, vx, vy (integer keys, u before v) between crossings, each once."""
    seg = segments.select("drawing_id", F.xxhash64("drawing_id", "x1", "y1", "x2", "y2").alias("s"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).where("x1 <> x2 or y1 <> y2").dropDuplicates(["drawing_id", "s"])
    boxed = lambda p: renamed(seg, p, "drawing_id").withColumns({f"{p}x0": F.least(f"{p}x1", f"{p}x2") - 1, f"{p}y0": F.least(f"{p}y1", f"{p}y2") - 1, f"{p}X": F.greatest(f"{p}x1", f"{p}x2") + 1, f"{p}Y": F.greatest(f"{p}y1", f"{p}y2") + 1})
    side = lambda p: boxed(p).withColumnsRenamed({f"{p}x1": f"{p}p", f"{p}y1": f"{p}q", f"{p}x2": f"{p}r", f"{p}y2": f"{p}t", f"{p}X": f"{p}x1", f"{p}Y": f"{p}y1"})
    both = boxes_meet(side("a"), side("b"), cell).where("as <> bs")
    a, b = ([F.col(p + c) for c in "pqrt"] for p in "ab")
    dx, dy = a[2] - a[0], a[3] - a[1]
    length2 = dx * dx + dy * dy
    along = lambda x, y: ((x - a[0]) * dx + (y - a[1]) * dy) / length2
    off = lambda x, y: F.abs((x - a[0]) * dy - (y - a[1]) * dx) / F.sqrt(length2)
    on = lambda x, y: F.when((off(x, y) < 0.5 / SCALE) & along(x, y).between(0, 1), along(x, y))
    hit = G.segment_intersection(*a, *b)
    ts = both.select("drawing_id", F.col("as").alias("s"), F.explode(F.array(along(hit["x"], hit["y"]), on(b[0], b[1]), on(b[2], b[3]))).alias("t")).where("t is not null and t > 0 and t < 1")
    inner = ts.groupBy("drawing_id", "s").agg(F.collect_set("t").alias("ts"))
    whole = seg.join(inner, ["drawing_id", "s"], "left").withColumn("ts", F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))
    key = lambda t, c: F.round((F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1"))) * SCALE).cast("bigint")
    points = whole.withColumn("p", F.transform("ts", lambda t: F.struct(key(t, "x").alias("x"), key(t, "y").alias("y"))))
    steps = points.select("drawing_id", F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("u"), F.slice("p", 2, F.size("p") - 1).alias("v"))).alias("e"))
    ordered = steps.select("drawing_id", F.least("e.u", "e.v").alias("u"), F.greatest("e.u", "e.v").alias("v")).where("u <> v")
    return ordered.select("drawing_id", F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("v.x").alias("vx"), F.col("v.y").alias("vy")).distinct()


EDGE = ["drawing_id", "ux", "uy", "vx", "vy"]


def half_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge (id h) with the next half-edge of its face: for the way back, the one before it around the point."""
    two = edges.unionByName(edges.select("drawing_id", F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy")))
    two = two.withColumn("angle", F.atan2((F.col("vy") - F.col("uy")).cast("double"), (F.col("vx") - F.col("ux")).cast("double")))
    here = Window.partitionBy("drawing_id", "ux", "uy").orderBy("angle")
    every = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    name = lambda *c: F.xxhash64("drawing_id", *c)
    before = F.coalesce(F.lag("h").over(here), F.last("h").over(every))
    around = two.withColumn("h", name("ux", "uy", "vx", "vy")).withColumn("next", before)
    return around.select("drawing_id", name("vx", "vy", "ux", "uy").alias("h"), F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"), "next")


#: Side of the tiles by which half-edges go to tasks, that of the strips in which a task reads them, and how many it follows at once.
TILE, STRIP, AT_ONCE = 16_000 * SCALE, 1000 * SCALE, 1_000_000


def followed(h: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest id of every half-edge's ring or way, the place of the last of its way (-1 in rings that close here), and whether it is a way's first."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    place = np.minimum(np.searchsorted(h[order], following), n - 1)
    here = h[order][place] == following
    to = np.where(here, order[place], np.arange(n))
    first = np.ones(n, bool)
    first[to[here]] = False
    low, last = h.copy(), ~here
    while True:
        ahead = low[to]
        if np.all(last[to] | (low == ahead)):  # before a way's end the two parts have no id in common
            break
        low, to = np.minimum(low, ahead), to[to]
    ends = last[to]
    return np.where(ends, np.minimum(low, h[to]), low), np.where(ends, to, -1), first & ends


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        h, following = rows.column("h").to_numpy(), rows.column("next").to_numpy()
        low, end, first = followed(h, following)
        out = rows.append_column("cycle", pa.array(low, pa.int64()))
        out = out.append_column("way", pa.array(np.where(end < 0, 0, h[end]), pa.int64(), mask=end < 0))
        out = out.append_column("onward", pa.array(following[np.maximum(end, 0)], pa.int64(), mask=~first))
        yield from out.to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield from run(held)
            held, n = [], 0
    if n:
        yield from run(held)


def cycles(halves: DataFrame, steps: Steps) -> DataFrame:
    """The half-edges with their cycle, the smallest id of the ring.

    Half-edges of a tile go to one task, which follows them as far as it has them: most rings close there, and any deal of half-edges to tasks would be right. What is
    left are ways from one task to another; these alone are tied by pointer jumping with the smallest id seen, in rounds that grow with the logarithm of the most ways
    that a ring has.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in halves.schema.fields)
    at = lambda size: [F.floor(F.col(c) / size) for c in ("ux", "uy")]
    dealt = halves.repartition("drawing_id", *at(TILE)).sortWithinPartitions("drawing_id", *at(TILE), *at(STRIP))
    rows = steps.cut(dealt.mapInArrow(_ways, f"{kinds}, cycle long, way long, onward long"))
    now, n = steps.cut_and_count(rows.where("onward is not null").select("drawing_id", "h", "way", F.col("onward").alias("next"), "cycle"), F.lit(True))
    while n:
        ahead = now.select("drawing_id", F.col("h").alias("next"), F.col("next").alias("far"), F.col("cycle").alias("c2"))
        moved = now.join(ahead, ["drawing_id", "next"]).select("drawing_id", "h", "way", F.col("far").alias("next"), F.least("cycle", "c2").alias("cycle"), (F.col("cycle") != F.col("c2")).alias("moving"))
        moved, n = steps.cut_and_count(moved, F.col("moving"))
        now = moved.drop("moving")
    closed = rows.where("way is null").drop("way", "onward")
    tied = rows.where("way is not null").drop("cycle", "onward").join(now.select("drawing_id", "way", "cycle"), ["drawing_id", "way"]).drop("way")
    return closed.unionByName(tied)


def traced(edges: DataFrame, steps: Steps) -> DataFrame:
    """Half-edges with their cycle, without dangles and other edges that have one face on both sides.

    Such an edge is in one cycle with both directions. They are the bridges of the graph, whole trees of dangles among them; when all are
    taken away at once no new one comes up, so the cycles are traced twice at most.
    """
    edges = steps.cut(edges)
    for _ in range(2):
        ring = steps.cut(cycles(half_edges(edges), steps))
        low = F.least(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y")))
        high = F.greatest(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y")))
        same = ring.groupBy("drawing_id", "cycle", low.alias("a"), high.alias("b")).count().where("count = 2")
        same, n = steps.cut_and_count(same.select("drawing_id", F.col("a.x").alias("ux"), F.col("a.y").alias("uy"), F.col("b.x").alias("vx"), F.col("b.y").alias("vy")), F.lit(True))
        if not n:
            break
        edges = steps.cut(edges.join(same, EDGE, "left_anti"))
    return ring


def polygonize(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounded faces (drawing_id, face, area, perimeter, centre, box, holes) and the half-edges of their rings, ``hole`` for those around holes.

    A contour (negative cycle) is a hole of the smallest face that holds one of its points and does not touch it there.
    """
    steps = Steps(edges.sparkSession)
    ring = traced(edges, steps)
    x = {c: F.col(c) / float(SCALE) for c in ("ux", "uy", "vx", "vy")}
    cross = x["ux"] * x["vy"] - x["vx"] * x["uy"]
    rings = steps.cut(
        ring.groupBy("drawing_id", "cycle").agg(
            (F.sum(cross) / 2).alias("signed"),
            F.sum(F.hypot(x["vx"] - x["ux"], x["vy"] - x["uy"])).alias("perimeter"),
            F.sum((x["ux"] + x["vx"]) * cross).alias("mx"),
            F.sum((x["uy"] + x["vy"]) * cross).alias("my"),
            *(f(c).alias(n) for f, c, n in ((F.min, "ux", "x0"), (F.min, "uy", "y0"), (F.max, "ux", "x1"), (F.max, "uy", "y1"))),
            F.min(F.struct("ux", "uy")).alias("first"),
        )
    )
    shells = rings.where("signed > 0")
    holes = rings.where("signed < 0").select("drawing_id", F.col("cycle").alias("hole"), F.col("first.ux").alias("x"), F.col("first.uy").alias("y"), (-F.col("signed")).alias("cut"), "mx", "my")
    sides = ring.select("drawing_id", F.col("cycle").alias("face"), "ux", "uy", "vx", "vy")
    boxes = shells.select("drawing_id", F.col("cycle").alias("face"), "x0", "y0", "x1", "y1")
    # few contours lie in the box of another ring: the edges of these rings alone are asked
    points = steps.cut(holes.select("drawing_id", "hole", "x", "y"))
    around = steps.cut(points_in_boxes(points, boxes, 4000.0 * SCALE).select("drawing_id", "face").distinct())
    asked = lambda df: df.join(around, ["drawing_id", "face"], "left_semi")
    tests = crossings(points, asked(boxes), asked(sides), ["hole"], 4000 * SCALE).where("k % 2 = 1 and not touches")
    inside = tests.join(shells.select("drawing_id", F.col("cycle").alias("face"), F.col("signed").alias("area")), ["drawing_id", "face"]).withColumnRenamed("face", "shell")
    owner = inside.groupBy("drawing_id", "hole").agg(F.min(F.struct("area", "shell")).alias("o")).select("drawing_id", "hole", F.col("o.shell").alias("cycle"))
    owner = steps.cut(owner)
    lost = holes.join(owner, ["drawing_id", "hole"]).groupBy("drawing_id", "cycle").agg(F.sum("cut").alias("cut"), F.sum("mx").alias("hx"), F.sum("my").alias("hy"), F.count("*").alias("holes"))
    whole = shells.join(lost, ["drawing_id", "cycle"], "left").na.fill(0, ["cut", "hx", "hy", "holes"])
    area = F.col("signed") - F.col("cut")
    box = {f"b{c}": F.col(c) / float(SCALE) for c in ("x0", "y0", "x1", "y1")}
    faces = whole.select(
        "drawing_id", F.col("cycle").alias("face"), area.alias("area"), "perimeter", ((F.col("mx") + F.col("hx")) / (6 * area)).alias("cx"), ((F.col("my") + F.col("hy")) / (6 * area)).alias("cy"), *(v.alias(k) for k, v in box.items()), "holes"
    )
    owned = owner.select("drawing_id", "hole", F.col("cycle").alias("face")).unionByName(shells.select("drawing_id", F.col("cycle").alias("hole"), F.col("cycle").alias("face")))
    outlines = ring.withColumnRenamed("cycle", "hole").join(owned, ["drawing_id", "hole"])
    return faces, outlines.select("drawing_id", "face", (F.col("hole") != F.col("face")).alias("hole"), "h", "ux", "uy", "vx", "vy", "next")


def face_rings(outlines: DataFrame) -> DataFrame:
    """Ordered rings: places along the chain by pointer jumping, then one array for each face."""
    steps = Steps(outlines.sparkSession)
    last = F.when(F.col("next") != F.col("face"), F.col("next"))
    now = steps.cut(outlines.where("not hole").select("drawing_id", "face", "h", "ux", "uy", last.alias("to"), F.when(last.isNull(), 0).otherwise(1).alias("left")))
    while not now.where("to is not null").isEmpty():
        ahead = now.select("drawing_id", F.col("h").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        now = steps.cut(now.join(ahead, ["drawing_id", "to"], "left").select("drawing_id", "face", "h", "ux", "uy", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    point = F.struct((-F.col("left")).alias("k"), (F.col("ux") / float(SCALE)).alias("x"), (F.col("uy") / float(SCALE)).alias("y"))
    rings = now.groupBy("drawing_id", "face").agg(F.array_sort(F.collect_list(point)).alias("r"))
    return rings.select("drawing_id", "face", F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def dissolve_edges(outlines: DataFrame, groups: DataFrame) -> DataFrame:
    """Boundary edges of each group of faces: those that only one of its faces has. groups: drawing_id, face, grp."""
    low, high = F.least(F.struct("ux", "uy"), F.struct(F.col("vx").alias("ux"), F.col("vy").alias("uy"))), F.greatest(F.struct("ux", "uy"), F.struct(F.col("vx").alias("ux"), F.col("vy").alias("uy")))
    own = outlines.join(groups, ["drawing_id", "face"]).groupBy("drawing_id", "grp", low.alias("a"), high.alias("b")).count().where("count = 1")
    return own.select("drawing_id", "grp", F.col("a.ux").alias("ux"), F.col("a.uy").alias("uy"), F.col("b.ux").alias("vx"), F.col("b.uy").alias("vy"))


# ---- gap closing ------------------------------------------------------------------------------


def snap_endpoints(segments: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Ends within the tolerance of each other move to the mean of all of them, counted as often as they occur.

    Groups are components: the smallest point is taken over, and pointers are followed, until nothing changes.
    """
    from tesselar.operators.cells import near_points

    steps = Steps(segments.sparkSession)
    ends = E.ends(segments).groupBy("drawing_id", "x", "y").agg(F.count("*").alias("n"))
    side = lambda p: ends.select("drawing_id", F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    near = steps.cut(near_points(side("a"), side("b"), tolerance).select("drawing_id", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("q")))
    end = lambda p: F.struct("drawing_id", F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"))
    found = components(ends.select(F.struct("drawing_id", "x", "y").alias("id")), near.where("p <> q").select(end("p").alias("a"), end("q").alias("b")), steps)
    label = found.select("id.drawing_id", F.struct("id.x", "id.y").alias("p"), F.struct("label.x", "label.y").alias("l"))
    label = label.join(ends.select("drawing_id", F.struct("x", "y").alias("p"), "n"), ["drawing_id", "p"])
    mean = lambda c: F.sum(F.col(f"p.{c}") * F.col("n")) / F.sum("n")
    to = label.groupBy("drawing_id", "l").agg(mean("x").alias("nx"), mean("y").alias("ny"))
    place = label.join(to, ["drawing_id", "l"]).select("drawing_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "nx", "ny")
    out = segments
    for k in "12":
        out = out.join(place.withColumnsRenamed({"x": f"x{k}", "y": f"y{k}", "nx": f"nx{k}", "ny": f"ny{k}"}), ["drawing_id", f"x{k}", f"y{k}"])
    return out.select("drawing_id", "seg_id", *(F.col(f"n{c}").alias(c) for c in ("x1", "y1", "x2", "y2")), "layer")


def close_gaps(segments: DataFrame, tier1: float = 500.0, tier2: float | None = None) -> DataFrame:
    """Bridges drawing_id, ax, ay, bx, by, distance: candidates, matching, and for the far tier a crossing check."""
    found = match_adopt(E.gap_candidates(segments, tier1, tier2))
    if tier2 is None:
        return found.select(*KEY, "distance")
    near, far = found.where(F.col("distance") <= tier1), found.where(F.col("distance") > tier1)
    return near.unionByName(not_crossing(far, segments)).select(*KEY, "distance")


def with_bridges(segments: DataFrame, bridges: DataFrame) -> DataFrame:
    """Segments and bridges, these on a layer of their own."""
    new = bridges.select("drawing_id", F.xxhash64(*KEY).alias("seg_id"), F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), F.lit("GAP_BRIDGE").alias("layer"))
    return segments.select("drawing_id", "seg_id", "x1", "y1", "x2", "y2", "layer").unionByName(new)


def renoded(segments: DataFrame) -> DataFrame:
    """Segments cut at all their crossings, each part with the layer of its segment (the first of several that lie on one another)."""
    steps = Steps(segments.sparkSession)
    own = steps.cut(segments.select("drawing_id", "seg_id", "x1", "y1", "x2", "y2", "layer"))
    edges = steps.cut(node_edges(own).select("drawing_id", *((F.col(c) / float(SCALE)).alias(c) for c in EDGE[1:])))
    # a part lies on its segment: both meet where the part's middle is
    middle = edges.withColumns({"x": (F.col("ux") + F.col("vx")) / 2, "y": (F.col("uy") + F.col("vy")) / 2})
    box = own.select("drawing_id", "layer", *(F.col(a).cast("double").alias(b) for a, b in zip(("x1", "y1", "x2", "y2"), ("sx", "sy", "ex", "ey"), strict=True)))
    box = box.withColumns({f"{c}0": F.least(f"s{c}", f"e{c}") for c in "xy"} | {f"{c}1": F.greatest(f"s{c}", f"e{c}") for c in "xy"})
    hit = points_in_boxes(middle, box, 2000.0, pad=1.0 / SCALE).where(G.point_segment_square(*(F.col(c) for c in ("x", "y", "sx", "sy", "ex", "ey"))) <= (1.0 / SCALE) ** 2)
    rows = hit.groupBy("drawing_id", *EDGE[1:]).agg(F.min(F.when(F.col("layer") != "GAP_BRIDGE", F.col("layer"))).alias("layer"))
    return rows.select("drawing_id", F.xxhash64("drawing_id", *EDGE[1:]).alias("seg_id"), F.col("ux").alias("x1"), F.col("uy").alias("y1"), F.col("vx").alias("x2"), F.col("vy").alias("y2"), F.coalesce("layer", F.lit("GAP_BRIDGE")).alias("layer"))


def iterative_close(segments: DataFrame, tier1: float = 500.0, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Closes, cuts at crossings, and closes again what that leaves or lays open, at most so many passes; and a row by drawing and pass."""
    steps = Steps(segments.sparkSession)
    now, history = segments, []
    for k in range(passes):
        bridges = steps.cut(close_gaps(now, tier1))
        closed = bridges.groupBy("drawing_id").agg(F.count("*").alias("closed"))
        before = E.free_ends(now).groupBy("drawing_id").agg(F.count("*").alias("free_before"))
        now = steps.cut(renoded(with_bridges(now, bridges)))
        after = E.free_ends(now).groupBy("drawing_id").agg(F.count("*").alias("free_after"))
        row = before.join(closed, "drawing_id", "left").join(after, "drawing_id", "left").na.fill(0)
        history.append(row.select("drawing_id", F.lit(k + 1).alias("pass"), "closed", "free_before", "free_after"))
        if bridges.isEmpty():
            break
    out = history[0]
    for h in history[1:]:
        out = out.unionByName(h)
    return now, out


def seeds_in_faces(seeds: DataFrame, faces: DataFrame, outlines: DataFrame | Traced) -> DataFrame:
    """seed_id and the smallest face that holds it (border edges decide by crossing parity)."""
    if isinstance(outlines, Traced):
        held = outlines.holding(seeds, "seed_id").join(faces.select("drawing_id", "face", "area"), ["drawing_id", "face"])
        return held.select("drawing_id", "seed_id", "face", "area")
    boxes = faces.select("drawing_id", "face", *(F.col(f"b{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    sides = outlines.select("drawing_id", "face", *((F.col(c) / float(SCALE)).alias(c) for c in ("ux", "uy", "vx", "vy")))
    inside = crossings(seeds.select("drawing_id", "seed_id", "x", "y"), boxes, sides, ["seed_id"], 4000.0).where("k % 2 = 1").join(faces.select("drawing_id", "face", "area"), ["drawing_id", "face"])
    return inside.groupBy("drawing_id", "seed_id").agg(F.min(F.struct("area", "face")).alias("f")).select("drawing_id", "seed_id", "f.face", "f.area")


def face_edges(outlines: DataFrame | Traced, faces: DataFrame | None = None) -> DataFrame:
    """Edges of traced faces (of these, or of all), holes among them, as polygons for an overlay: drawing_id, id, ux, uy, vx, vy in drawing units."""
    if isinstance(outlines, Traced):
        return outlines.outlines(outlines.faces if faces is None else faces).withColumnRenamed("face", "id")
    own = outlines if faces is None else outlines.join(faces.select("drawing_id", "face"), ["drawing_id", "face"], "left_semi")
    return own.select("drawing_id", F.col("face").alias("id"), *((F.col(c) / float(SCALE)).alias(c) for c in EDGE[1:]))


def slab_outlines(segments: DataFrame, least: float = 1e8) -> DataFrame:
    """drawing_id, method, area, perimeter of the outline that a layer's segments give.

    Gaps are closed and faces traced; faces of 100 m2 and more (in drawing units) are united, and the largest connected part is the outline. Drawings without such a
    face get the convex hull of their ends.
    """
    steps = Steps(segments.sparkSession)
    own = steps.cut(segments)
    lines = steps.cut(with_bridges(own, close_gaps(own)))
    found, outlines = polygonize(node_edges(lines))
    large = steps.cut(found.where(F.col("area") >= least).select("drawing_id", "face", "area"))
    low = F.least(F.struct("ux", "uy"), F.struct(F.col("vx").alias("ux"), F.col("vy").alias("uy")))
    high = F.greatest(F.struct("ux", "uy"), F.struct(F.col("vx").alias("ux"), F.col("vy").alias("uy")))
    sides = outlines.join(large.select("drawing_id", "face"), ["drawing_id", "face"]).groupBy("drawing_id", low.alias("u"), high.alias("v")).agg(F.min("face").alias("a"), F.max("face").alias("b"))
    name = lambda c: F.struct("drawing_id", F.col(c).alias("face"))
    part = components(large.select(name("face").alias("id")), sides.where("a <> b").select(name("a").alias("a"), name("b").alias("b")), steps)
    part = part.select("id.drawing_id", "id.face", F.col("label.face").alias("grp"))
    united = large.join(part, ["drawing_id", "face"]).groupBy("drawing_id", "grp").agg(F.sum("area").alias("area"), F.count("*").alias("n"))
    best = united.groupBy("drawing_id").agg(F.max(F.struct("area", "grp")).alias("m"), F.sum("n").alias("n")).select("drawing_id", "m.area", "m.grp", "n")
    long = F.hypot((F.col("vx") - F.col("ux")).cast("double"), (F.col("vy") - F.col("uy")).cast("double")) / float(SCALE)
    around = dissolve_edges(outlines, part).groupBy("drawing_id", "grp").agg(F.sum(long).alias("perimeter"))
    closed = best.join(around, ["drawing_id", "grp"]).select("drawing_id", F.when(F.col("n") > 1, "polygonize_union").otherwise("polygonize").alias("method"), "area", "perimeter")
    closed = steps.cut(closed)
    hull = convex_hulls(E.ends(own).select("drawing_id", "x", "y").join(closed.select("drawing_id"), "drawing_id", "left_anti"))
    hull = hull.select("drawing_id", F.lit("convex_hull").alias("method"), G.ring_area(F.col("ring")).alias("area"), G.ring_perimeter(F.col("ring")).alias("perimeter"))
    return closed.unionByName(hull)
