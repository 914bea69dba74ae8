"""Further queries: parts of other operators on their own, and compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.functions import review as R
from tesselar.functions import text as X
from tesselar.operators import endpoints as E
from tesselar.operators import gaps as P
from tesselar.operators import topology as T
from tesselar.plans import joins as J
from tesselar.plans import reviews as V
from tesselar.plans import summaries as S
from tesselar.plans.filters import ACTIVE, SLAB
from tesselar.plans.registry import query
from tesselar.plans.topology import GIVEN, opened, resolved_seeds, seed_resolve, traced_open
from tesselar.plans.windows import AXES, target_sql

D, DELTA = "cast(seg_id % 400 as double)", "cast(seg_id % 181 as double)"
PROFILE = f"((abs({D} - 150) <= 5 or abs({D} - 180) <= 5) and {DELTA} >= 135)"
MICRO = f"({D} <= 15 and ({DELTA} <= 35 or {DELTA} between 85 and 95 or {DELTA} >= 175))"


def _pair():
    return (F.col("seg_id") % 400).cast("double"), (F.col("seg_id") % 181).cast("double")


@query("segments", sql=f"select seg_id, {PROFILE} as profile from segments")
def is_wall_offset_profile(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", G.is_wall_offset_profile(*_pair()).alias("profile"))


@query("segments", sql=f"select seg_id, {MICRO} as micro from segments")
def is_micro_gap(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", G.is_micro_gap(*_pair()).alias("micro"))


@query("segments", sql="select seg_id, cast(case when seg_id % 180 > 90 then 180 - seg_id % 180 else seg_id % 180 end as double) as delta from segments")
def axis_angle_delta(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", G.axis_angle_delta(F.col("seg_id").cast("double"), F.lit(0.0)).alias("delta"))


@query("segments", sql="select seg_id, (seg_id % 90 <= 2 or seg_id % 90 >= 88) as orthogonal from segments")
def is_orthogonal(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", G.is_orthogonal((F.col("seg_id") % 180).cast("double")).alias("orthogonal"))


@query("segments", sql="select seg_id, x1 * 1000000 as kx, y1 * 1000000 as ky from segments")
def round_point(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", G.round_point(F.col("x1") + F.lit(1e-8)).alias("kx"), G.round_point(F.col("y1") - F.lit(1e-8)).alias("ky"))


@query("segments", sql='select drawing_id, ax, ay, least(ax, bx) - 250 as x0, least(ay, by_) - 250 as y0, greatest(ax, bx) + 250 as x1, greatest(ay, by_) + 250 as y1 from candidate_pairs')
def gap_bbox(segments: DataFrame) -> DataFrame:
    low = lambda c: (F.least(f"a{c}", f"b{c}") - 250).alias(f"{c}0")
    high = lambda c: (F.greatest(f"a{c}", f"b{c}") + 250).alias(f"{c}1")
    return E.gap_candidates(segments, 500.0).select("drawing_id", "ax", "ay", low("x"), low("y"), high("x"), high("y"))


@query("segments", sql="select drawing_id, ax, ay, status, case status when 'within_threshold_unclosed' then 100 when 'above_threshold_close' then 80 when 'orphan_endpoint' then 60 else 40 end as priority from gaps")
def gap_candidate_status(segments: DataFrame) -> DataFrame:
    """Gaps whose status has a priority."""
    return P.gaps(segments).withColumn("priority", P.priority(F.col("status"))).where("priority is not null").select("drawing_id", "ax", "ay", "status", "priority")


@query("segments", sql="select g.drawing_id, g.ax, g.ay, 'Gap status: ' || g.status || case when g.distance is null then '' else '; distance=' || cast(round(g.distance, 3) as varchar) end || case when f.reason is null then '' else '; failure_reason=' || f.reason end as reason from gaps g left join gap_failed f on f.drawing_id = g.drawing_id and f.ax = g.ax and f.ay = g.ay")
def gap_reason_text(segments: DataFrame) -> DataFrame:
    return J.with_reasons(P.gaps(segments)).select("drawing_id", "ax", "ay", X.gap_reason_text(F.col("status"), F.col("distance"), F.col("reason")).alias("reason"))


@query("segments", sql="select seg_id, case when length(repeat(layer, 9)) > 60 then left(repeat(layer, 9), 60) || '…' else repeat(layer, 9) end as short from segments")
def truncate_ellipsis(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", X.truncate_ellipsis(F.repeat("layer", 9)).alias("short"))


@query("faces", sql="select face_id, round((x1 - x0) * (y1 - y0) * 1.0, 4) as area, round(2.0 * (x1 - x0 + y1 - y0), 4) as perimeter, (x0 + x1) / 2.0 as cx, (y0 + y1) / 2.0 as cy from faces")
def ring_metrics(faces: DataFrame) -> DataFrame:
    ring = G.normalize_ring(G.rect_ring())
    c = G.ring_centroid(ring)
    return faces.select("face_id", F.round(G.ring_area(ring), 4).alias("area"), F.round(G.ring_perimeter(ring), 4).alias("perimeter"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"))


@query("faces", sql="select face_id, case face_id % 4 when 0 then 'drawn' when 1 then 'cad_pick' when 2 then 'auto_layer' end as source, (face_id % 4 < 3) as valid from faces")
def boundary_build(faces: DataFrame) -> DataFrame:
    """A boundary needs a valid ring and one of three sources; the fourth name is none of them."""
    given = F.element_at(F.array(*(F.lit(x) for x in ("drawn", "cad_pick", "auto_layer", "guessed"))), (F.col("face_id") % 4 + 1).cast("int"))
    known = given.isin("drawn", "cad_pick", "auto_layer")
    return faces.select("face_id", F.when(known, given).alias("source"), (known & G.ring_validity(G.rect_ring())).alias("valid"))


@query("faces", sql="select face_id, 'mm' as unit, cast(4 as bigint) as points, (face_id % 2 = 0) as applied from faces")
def scope_normalize(faces: DataFrame) -> DataFrame:
    """Scopes as JSON text, some without a field, read to one struct with defaults."""
    part = F.struct(G.rect_ring().alias("ring"), F.when(F.col("face_id") % 2 == 0, F.lit(True)).alias("applied"))
    text = faces.select("face_id", F.to_json(F.struct(part.alias("boundary"))).alias("t"))
    scope = F.from_json("t", "struct<unit:string,boundary:struct<ring:array<struct<x:double,y:double>>,applied:boolean>>")
    return text.select("face_id", F.coalesce(scope["unit"], F.lit("mm")).alias("unit"), F.size(scope["boundary"]["ring"]).cast("bigint").alias("points"), F.coalesce(scope["boundary"]["applied"], F.lit(False)).alias("applied"))


@query("redrawn", "records", sql=f"select n.face_id, case when not (n.x0 >= 2000 and n.y0 >= 2000 and n.x1 <= 46000 and n.y1 <= 46000) then 'outside scope' when exists (select 1 from records r where n.drawing_id = r.drawing_id and {ACTIVE} and n.x0 < r.x1 and r.x0 < n.x1 and n.y0 < r.y1 and r.y0 < n.y1 and 100 * (least(n.x1, r.x1) - greatest(n.x0, r.x0)) * (least(n.y1, r.y1) - greatest(n.y0, r.y0)) >= 95 * ((n.x1 - n.x0) * (n.y1 - n.y0) + r.area_native - (least(n.x1, r.x1) - greatest(n.x0, r.x0)) * (least(n.y1, r.y1) - greatest(n.y0, r.y0)))) then 'overlaps existing' else 'ok' end as reason from redrawn n")
def manual_polygon_check(redrawn: DataFrame, records: DataFrame) -> DataFrame:
    """The first failing check of a drawn ring: its shape, the scope that must cover all of it, an active polygon that it repeats."""
    ring = G.normalize_ring(G.rect_ring())
    live = records.where(R.is_active(F.col("status"), F.col("scope_excluded")))
    taken = J.overlapping_boxes(redrawn, live, 95).select("face_id").distinct().withColumn("taken", F.lit(True))
    inside = F.expr("x0 >= 2000 and y0 >= 2000 and x1 <= 46000 and y1 <= 46000")
    first = F.coalesce(F.when(~G.ring_validity(ring), "invalid ring"), F.when(~inside, "outside scope"), F.when(F.col("taken"), "overlaps existing"), F.lit("ok"))
    return redrawn.join(taken, "face_id", "left").select("face_id", first.alias("reason"))


@query("seeds", "segments", sql=f"select seed_id, round(x + 75 * case when d > 1e-6 then (x - px) / d else case when sy = ey then 0 else -1 end end, 3) as x, round(y + 75 * case when d > 1e-6 then (y - py) / d else case when sy = ey then 1 else 0 end end, 3) as y from (select *, sqrt(d2) as d, least(greatest(x, sx), ex) as px, least(greatest(y, sy), ey) as py from ({J.NEAREST}) n) m", name="offset_inward")
def offset_inward(seeds: DataFrame, segments: DataFrame) -> DataFrame:
    """Seeds moved 75 away from the nearest segment, or along its normal when they lie on it."""
    return moved_inward(seeds, segments, ["seed_id"]).select("seed_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def moved_inward(points: DataFrame, segments: DataFrame, ids: list[str], by: float = 75.0) -> DataFrame:
    best = J.nearest_segments(points, segments, ids)
    both = points.join(best, ids)
    x, y, sx, sy, ex, ey = (F.col(c).cast("double") for c in ("x", "y", "sx", "sy", "ex", "ey"))
    dx, dy = ex - sx, ey - sy
    t = F.coalesce(((x - sx) * dx + (y - sy) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    px, py, d = sx + t * dx, sy + t * dy, F.sqrt("d2")
    long = F.coalesce(F.nullif(F.hypot(dx, dy), F.lit(0.0)), F.lit(1.0))
    step = lambda away, normal: F.when(d > 1e-6, away / F.nullif(d, F.lit(0.0))).otherwise(normal / long) * by
    return both.select(*[c for c in points.columns if c not in ("x", "y")], (x + step(x - px, -dy)).alias("x"), (y + step(y - py, dx)).alias("y"))


@query("faces", sql="select face_id, round((x1 - x0) * (y1 - y0) / 4.0, 1) as area, cast(2 as bigint) as parts from faces", name="normalize_polygon")
def normalize_polygon(faces: DataFrame) -> DataFrame:
    """Rings crossed by swapping two corners, repaired: the largest of their parts."""
    from tesselar.operators.rings import repaired

    corners = F.array(*(G.point(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1"))))
    found, _ = repaired(faces.select(F.col("face_id").alias("id"), corners.alias("ring")))
    return found.select(F.col("id").alias("face_id"), F.round("area", 1).alias("area"), "parts")


@query("faces", sql="select drawing_id, drawing_id || ',' || face_id || ',' || ((x1 - x0) * (y1 - y0)) as line from faces union all select drawing_id, drawing_id || ',TOTAL,' || cast(sum((x1 - x0) * (y1 - y0)) as bigint) from faces group by 1")
def regions_csv(faces: DataFrame) -> DataFrame:
    from tesselar.plans.files import regions_report

    return regions_report(faces).select("drawing_id", F.to_csv(F.struct("drawing_id", "region", "area")).alias("line"))


#: Bays that the frame aims at: more than some drawings' axes can give.
FRAME = 60


@query("grid_lines", sql=f"select a.drawing_id, nx, ny, columns, rows, mode, columns * rows as bays, case when columns * rows < 4 then 'few bays' else '' end as warning from ({AXES}) a join ({target_sql(FRAME)}) t on t.drawing_id = a.drawing_id", name="grid_frame")
def grid_frame(lines: DataFrame) -> DataFrame:
    """By drawing: axes of both families, the bays chosen from them for the target, in which mode, and a warning when they are too few."""
    from tesselar.operators import grid
    from tesselar.plans.windows import axis_counts

    n = axis_counts(lines)
    both = n.join(grid.axis_target(n, FRAME), "drawing_id")
    bays = F.col("columns") * F.col("rows")
    return both.select("drawing_id", "nx", "ny", "columns", "rows", "mode", bays.alias("bays"), F.when(bays < 4, "few bays").otherwise("").alias("warning"))


@query("segments", name="auto_boundary")
def auto_boundary(segments: DataFrame) -> DataFrame:
    from tesselar.plans.topology import slab_outline

    return slab_outline(segments).select("drawing_id", F.lit("auto_layer").alias("source"), "area", "perimeter")


@query("records", sql=f"select drawing_id, cast(count(*) filter (where {SLAB}) as bigint) as inside, cast(count(*) filter (where not ({SLAB})) as bigint) as excluded, cast(count(*) filter (where {SLAB} and geometry_role = 'obstacle') as bigint) as obstacles from records group by 1")
def scoped_detection(records: DataFrame) -> DataFrame:
    """Clip once, classify once, count."""
    inside = (F.col("x0") + F.col("x1")).between(10_000, 80_000) & (F.col("y0") + F.col("y1")).between(10_000, 80_000)
    role = R.is_obstacle(F.col("geometry_role"))
    return records.groupBy("drawing_id").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("excluded"), F.count_if(inside & role).alias("obstacles"))


@query("segments", sql="select drawing_id, case when drawing_id % 6 = 5 then 'suffix' else 'ok' end as \"check\" from (select distinct drawing_id from segments) d")
def drawing_arrivals(segments: DataFrame) -> DataFrame:
    """Drawings written as tag files, some under a name that is no drawing's, through the checks of arrivals."""
    from tesselar.plans.files import number, written
    from tesselar.sources.tags import drawing_catalog
    from tesselar.streaming.reviews import arrivals

    suffix = F.when(F.col("drawing") % 6 == 5, ".exe").otherwise(".DXF")
    found = drawing_catalog(segments.sparkSession, written(segments), "*.txt").groupBy(number("path")).agg(F.sum("length").alias("length"))
    files = found.select("drawing", F.concat(F.lit("in/"), F.col("drawing").cast("string"), suffix).alias("path"), "length")
    return arrivals(files).select(F.regexp_extract("path", r"/(\d+)", 1).cast("bigint").alias("drawing_id"), "check")


@query("records", "redrawn", sql=f"select face_id, 'auto' as provenance from records where source = 'auto' and {ACTIVE} union all select n.face_id, 'seed_assisted' from redrawn n where not exists (select 1 from records r where r.source = 'auto' and {ACTIVE} and n.drawing_id = r.drawing_id and n.x0 < r.x1 and r.x0 < n.x1 and n.y0 < r.y1 and r.y0 < n.y1 and 100 * (least(n.x1, r.x1) - greatest(n.x0, r.x0)) * (least(n.y1, r.y1) - greatest(n.y0, r.y0)) >= 90 * ((n.x1 - n.x0) * (n.y1 - n.y0) + r.area_native - (least(n.x1, r.x1) - greatest(n.x0, r.x0)) * (least(n.y1, r.y1) - greatest(n.y0, r.y0))))")
def merge_regions(records: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Automatic regions, and of seeded ones (here the second drawing) those that share less than 90 % with each of them."""
    auto = records.where(R.is_active(F.col("status"), F.col("scope_excluded")) & (F.col("source") == "auto"))
    gone = J.overlapping_boxes(redrawn, auto, 90).select("face_id").distinct()
    return auto.select("face_id", F.lit("auto").alias("provenance")).unionByName(redrawn.select("face_id").join(gone, "face_id", "left_anti").withColumn("provenance", F.lit("seed_assisted")))


@query("seeds", "faces", name="seed_resolve_all")
def seed_resolve_all(seeds: DataFrame, faces: DataFrame) -> DataFrame:
    return seed_resolve(seeds, faces).groupBy("status").agg(F.count("*").alias("seeds"))


@query("faces", name="seed_candidates")
def seed_candidates(faces: DataFrame) -> DataFrame:
    """Seeds made from the plan's open gaps, beside their middles, that resolve to a region of their own."""
    from tesselar.operators.seeds import resolve

    own = opened(faces)
    middle = {c: (F.col(f"a{c}") + F.coalesce(f"b{c}", f"a{c}")) / 2 for c in "xy"}
    points = P.gaps(own).select("drawing_id", "ax", "ay", *(v.alias(k) for k, v in middle.items()))
    moved = moved_inward(points, own, ["drawing_id", "ax", "ay"]).withColumns({c: F.round(c, 1) for c in "xy"})
    seeds = E.first_by(moved, ["drawing_id", "x", "y"], F.col("ax"), F.col("ay")).withColumn("seed_id", F.xxhash64("drawing_id", "x", "y"))
    found = traced_open(faces)
    got = resolve(seeds, own, found.faces, found, found.faces.where(F.col("area") >= GIVEN))
    return got.where("status = 'ok'").select("drawing_id", "x", "y", "method", F.round("area", 1).alias("area"))


@query("seeds", "faces", name="local_repair")
def local_repair(seeds: DataFrame, faces: DataFrame) -> DataFrame:
    """Seeds that no face of the plan holds, and what the repair around each has given."""
    rows = resolved_seeds(seeds, faces).where("status <> 'invalid' and coalesce(method, 'repair') = 'repair'")
    return rows.select("seed_id", "status", F.round("area", 1).alias("area"))


@query("seeds", "faces", name="local_repair_candidates")
def local_repair_candidates(seeds: DataFrame, faces: DataFrame) -> DataFrame:
    """Seeds with a region of their own by local repair."""
    return resolved_seeds(seeds, faces).where("status = 'ok' and method = 'repair'").select("seed_id", F.round("area", 1).alias("area"))
