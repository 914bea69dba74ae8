"""Review events, records and versions as queries; folds in batch, with the same rules as the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import review as R
from tesselar.plans.filters import ACTIVE, PARTITION
from tesselar.plans.joins import DUPLICATE, MATCH, OV, PRINTS, RESOLVED
from tesselar.plans.registry import query


@query("review_events", sql="select session_id, event_id, action, n from (select *, row_number() over (partition by session_id order by ts desc, event_id desc) as n from review_events) t where n <= 100")
def action_log(events: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())).cast("bigint")
    return events.withColumn("n", n).where("n <= 100").select("session_id", "event_id", "action", "n")


@query("review_events", sql="select session_id, max(ts) filter (where action in ('recover', 'delete')) > max(ts) filter (where action = 'approve') as stale from review_events group by 1")
def zones_stale(events: DataFrame) -> DataFrame:
    """Stale: an edit after the last build (an approval stands for it)."""
    edit = F.max(F.when(F.col("action").isin("recover", "delete"), F.col("ts")))
    return events.groupBy("session_id").agg((edit > F.max(F.when(F.col("action") == "approve", F.col("ts")))).alias("stale"))


STEP = "case action when 'open_gap' then 1 when 'select' then 2 when 'recover' then 3 when 'approve' then 4 end"


@query("review_events", sql=f"select day, cast(sum(case when s >= 1 then 1 else 0 end) as bigint) as found, cast(sum(case when s >= 2 then 1 else 0 end) as bigint) as clicked, cast(sum(case when s >= 3 then 1 else 0 end) as bigint) as recovered, cast(sum(case when s >= 4 then 1 else 0 end) as bigint) as useful from (select date_trunc('day', ts)::date as day, session_id, max({STEP}) as s from review_events group by 1, 2) t group by 1")
def gap_recovery_funnel(events: DataFrame) -> DataFrame:
    from tesselar.streaming.reviews import funnel

    return funnel(events)


FOLD = "select session_id, face_id, action from (select *, row_number() over (partition by session_id, face_id order by ts desc, event_id desc) as r from review_events where action in ('recover', 'approve', 'delete')) t where r = 1"


@query("review_events", sql=f"select session_id, face_id, case action when 'delete' then 'deleted' when 'approve' then 'approved' else 'recovered' end as state from ({FOLD}) f")
def review_fold(events: DataFrame) -> DataFrame:
    """State of a polygon in a session: what its last command made of it."""
    last = F.max_by("action", F.struct("ts", "event_id"))
    state = events.where(F.col("action").isin("recover", "approve", "delete")).groupBy("session_id", "face_id").agg(last.alias("action"))
    return state.select("session_id", "face_id", F.when(F.col("action") == "delete", "deleted").when(F.col("action") == "approve", "approved").otherwise("recovered").alias("state"))


@query("review_events", name="undo_redo_fold")
def undo_redo_fold(events: DataFrame) -> DataFrame:
    """Depth of the undo and redo lists by session after all events in order (open_gap undoes, select redoes)."""
    from tesselar.streaming.reviews import replay_history

    return replay_history(events)


@query("records", sql=f"select zone, cast(count(*) as bigint) as records, cast(sum(area_native) as bigint) as area from (select case when zone in ('INT-1', 'INT-2') then 'INT-1' when zone = 'INT-3' then 'North' else zone end as zone, area_native from records where {PARTITION}) t group by 1")
def zone_merge(records: DataFrame) -> DataFrame:
    """INT-2 joins INT-1 and INT-3 gets a new name: labels are mapped, then zones are built anew."""
    live = records.where(R.is_partition(F.col("status"), F.col("scope_excluded"), F.col("geometry_role")))
    zone = F.when(F.col("zone") == "INT-2", "INT-1").when(F.col("zone") == "INT-3", "North").otherwise(F.col("zone"))
    return live.groupBy(zone.alias("zone")).agg(F.count("*").alias("records"), F.sum("area_native").alias("area"))


@query("records", sql="select face_id, case when zone = 'INT-3' then 'North' else zone end as zone from records")
def zone_rename(records: DataFrame) -> DataFrame:
    return records.select("face_id", F.when(F.col("zone") == "INT-3", "North").otherwise(F.col("zone")).alias("zone"))


ISSUES = f"select drawing_id, face_id, cast(null as bigint) as related_id, 'tiny_polygon' as issue, 'warning' as severity from records where {ACTIVE} and area_native < 500000 union all select drawing_id, a, b, case when 100 * shared > 85 * aa and 100 * shared > 85 * ba then 'duplicate' else 'overlap' end, 'warning' from ({OV.format('(select * from records where ' + ACTIVE + ')')}) o where shared > 100000 union all select drawing_id, face_id, null, 'open_boundary', 'error' from records where {ACTIVE} and (x1 <= x0 or y1 <= y0)"


@query("records", sql=ISSUES)
def workspace_issues(records: DataFrame) -> DataFrame:
    return issues(records)


def issues(records: DataFrame) -> DataFrame:
    """Faults of active polygons: rings that do not close or cross themselves (tested before any repair), tiny ones, and pairs that repeat or
    overlap each other."""
    from tesselar.functions import geom as G
    from tesselar.plans.joins import self_overlap

    live = records.where(R.is_active(F.col("status"), F.col("scope_excluded")))
    ring = G.normalize_ring(G.rect_ring())
    flat = (F.size(ring) < 3) | (G.ring_area(ring) == 0)
    row = lambda issue, severity: F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))
    own = F.array_compact(F.array(F.when(F.col("area_native") < 500_000, row("tiny_polygon", "warning")), F.when(flat, row("open_boundary", "error")), F.when(~flat & ~G.ring_validity(ring), row("self_intersection", "warning"))))
    alone = live.select("drawing_id", "face_id", F.lit(None).cast("bigint").alias("related_id"), F.explode(own).alias("i")).select("drawing_id", "face_id", "related_id", "i.*")
    pair = F.when(F.expr("100 * shared > 85 * aa and 100 * shared > 85 * ba"), "duplicate").otherwise("overlap")
    both = self_overlap(live.select("drawing_id", "face_id", "x0", "y0", "x1", "y1")).where("shared > 100000")
    return alone.unionByName(both.select("drawing_id", F.col("a").alias("face_id"), F.col("b").alias("related_id"), pair.alias("issue"), F.lit("warning").alias("severity")))


@query("records", sql=f"select drawing_id, row_number() over (partition by drawing_id order by face_id) as place, face_id, area_native from records where {PARTITION}")
def faces_from_records(records: DataFrame) -> DataFrame:
    live = records.where(R.is_partition(F.col("status"), F.col("scope_excluded"), F.col("geometry_role")))
    return live.select("drawing_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("face_id")).cast("bigint").alias("place"), "face_id", "area_native")


@query("faces", sql="select drawing_id, face_id, row_number() over (partition by drawing_id order by face_id) as place from faces")
def faces_from_polygons(faces: DataFrame) -> DataFrame:
    return faces.select("drawing_id", "face_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("face_id")).cast("bigint").alias("place"))


@query("records", sql=f"select face_id, 'detected' as kind, 0.9 as confidence from records where source = 'auto' and {ACTIVE}")
def detected_records(records: DataFrame) -> DataFrame:
    live = records.where((F.col("source") == "auto") & R.is_active(F.col("status"), F.col("scope_excluded")))
    return live.select("face_id", F.lit("detected").alias("kind"), F.lit(0.9).alias("confidence"))


GEOMETRY = "select drawing_id, layer, cast(count(*) as bigint) as n from entities where entity_type <> 'INSERT' group by 1, 2"


LAYER_MISSES = f"with own as (select distinct l.drawing_id, l.layer from ({GEOMETRY}) l join layer_config c on c.drawing_id = l.drawing_id and upper(c.layer) = upper(l.layer)) select l.drawing_id, l.layer, 'at_risk' as status, 'layer_selection_miss' as category, 0.6 as confidence, l.n as entities from ({GEOMETRY}) l where l.n >= 4 and not regexp_matches(upper(l.layer), 'DIM|TEXT|HATCH|GRID|ANNO|NOTE') and not exists (select 1 from own o where o.drawing_id = l.drawing_id and o.layer = l.layer) and l.drawing_id in (select drawing_id from own) union all select c.drawing_id, string_agg(distinct c.layer, ',' order by c.layer), 'missed', 'layer_selection_miss', 0.95, 0 from layer_config c where c.drawing_id in (select drawing_id from entities) and c.drawing_id not in (select drawing_id from own) group by 1"


@query("entities", "layer_config", sql=LAYER_MISSES)
def layer_miss_records(entities: DataFrame, config: DataFrame) -> DataFrame:
    """Layers with four entities or more that the configured ones leave out, and configurations without any geometry."""
    by = entities.where(F.col("entity_type").isin(*R.SUPPORTED)).groupBy("drawing_id", "layer").agg(F.count("*").alias("n")).withColumn("up", F.upper("layer"))
    named = config.select("drawing_id", F.upper("layer").alias("up")).distinct()
    own = by.join(named, ["drawing_id", "up"], "left_semi")
    left = by.join(named, ["drawing_id", "up"], "left_anti").join(own.select("drawing_id").distinct(), "drawing_id", "left_semi")
    left = left.where((F.col("n") >= 4) & ~F.col("up").rlike("DIM|TEXT|HATCH|GRID|ANNO|NOTE"))
    record = lambda df, layer, status, confidence, n: df.select("drawing_id", layer.alias("layer"), F.lit(status).alias("status"), F.lit("layer_selection_miss").alias("category"), F.lit(confidence).alias("confidence"), n.alias("entities"))
    bare = config.join(entities.select("drawing_id").distinct(), "drawing_id", "left_semi").join(own.select("drawing_id").distinct(), "drawing_id", "left_anti").groupBy("drawing_id").agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))
    return record(left, F.col("layer"), "at_risk", 0.6, F.col("n")).unionByName(record(bare, F.col("layers"), "missed", 0.95, F.lit(0).cast("bigint")))


OPEN_POINTS = "select distinct drawing_id, x, y from (select drawing_id, ax as x, ay as y from gaps where status <> 'above_threshold_close' union all select drawing_id, bx, by_ from gaps where status in ('within_threshold_unclosed', 'large_gap_manual_review')) g"
NEAR_INSERT = f"select drawing_id, x, y, layer, round(sqrt(d2), 2) as distance from (select g.drawing_id, g.x, g.y, i.layer, power(g.x - i.x, 2) + power(g.y - i.y, 2) as d2, row_number() over (partition by g.drawing_id, g.x, g.y order by power(g.x - i.x, 2) + power(g.y - i.y, 2), i.layer) as r from ({OPEN_POINTS}) g join (select distinct drawing_id, layer, x, y from entities where entity_type = 'INSERT') i on i.drawing_id = g.drawing_id and power(g.x - i.x, 2) + power(g.y - i.y, 2) <= 2250000) n where r = 1"


ENTITY_MISSES = f"select drawing_id, x, y, layer, 'INSERT' as entity_type, 0.75 as confidence, distance from ({NEAR_INSERT}) n union all select drawing_id, null, null, '*', string_agg(distinct entity_type, ',' order by entity_type), 0.7, null from entities where entity_type not in ('LINE', 'LWPOLYLINE', 'POLYLINE', 'ARC') group by 1"


@query("entities", "segments", sql=ENTITY_MISSES)
def entity_miss_records(entities: DataFrame, segments: DataFrame) -> DataFrame:
    """Open gap points with an insert within 1,500 (the nearest one's layer), and one row by drawing that names its unsupported types."""
    from tesselar.operators.cells import near_points
    from tesselar.operators.gaps import gaps

    point = lambda p: gaps(segments).where(F.col(f"{p}x").isNotNull() & (F.col("status") != "above_threshold_close")).select("drawing_id", F.col(f"{p}x").alias("ax"), F.col(f"{p}y").alias("ay"))
    points = point("a").unionByName(point("b")).distinct()
    inserts = entities.where("entity_type = 'INSERT'").select("drawing_id", "layer", F.col("x").alias("bx"), F.col("y").alias("by")).distinct()
    near = near_points(points, inserts, 1500).groupBy("drawing_id", "ax", "ay").agg(F.min(F.struct("d2", "layer")).alias("n"))
    near = near.select("drawing_id", F.col("ax").alias("x"), F.col("ay").alias("y"), "n.layer", F.lit("INSERT").alias("entity_type"), F.lit(0.75).alias("confidence"), F.round(F.sqrt(F.col("n.d2").cast("double")), 2).alias("distance"))
    none = entities.where(~F.col("entity_type").isin(*R.SUPPORTED)).groupBy("drawing_id").agg(F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("entity_type"))
    empty = F.lit(None)
    return near.unionByName(none.select("drawing_id", empty.cast("bigint").alias("x"), empty.cast("bigint").alias("y"), F.lit("*").alias("layer"), "entity_type", F.lit(0.7).alias("confidence"), empty.cast("double").alias("distance")))


MISSED = "select g.drawing_id, g.ax, g.ay, g.bx, g.by_ as \"by\", case g.status when 'within_threshold_unclosed' then 'missed' else 'at_risk' end as status, case g.status when 'within_threshold_unclosed' then 0.85 when 'orphan_endpoint' then 0.65 else 0.7 end as confidence, coalesce(case f.reason when 'greedy_pairing_conflict' then 'pairing_conflict_miss' when 'bearing_mismatch_suspected' then 'bearing_mismatch_miss' end, 'gap_blocked_closure') as category, trim(g.al || '|' || g.bl, '|') as layer, (g.ax + coalesce(g.bx, g.ax)) / 2.0 as cx, (g.ay + coalesce(g.by_, g.ay)) / 2.0 as cy from gaps g left join gap_failed f on f.drawing_id = g.drawing_id and f.ax = g.ax and f.ay = g.ay"


@query("segments", sql=MISSED)
def gap_miss_records(segments: DataFrame) -> DataFrame:
    """A record for each gap and orphan, with its centre, the layers on both sides, and a category from the failure reason."""
    from tesselar.operators import gaps as P
    from tesselar.plans.joins import with_reasons

    every = with_reasons(P.gaps(segments))
    within, lone = F.col("status") == "within_threshold_unclosed", F.col("status") == "orphan_endpoint"
    category = F.when(F.col("reason") == P.PAIRING, "pairing_conflict_miss").when(F.col("reason") == P.BEARING, "bearing_mismatch_miss").otherwise("gap_blocked_closure")
    middle = lambda c: ((F.col(f"a{c}") + F.coalesce(f"b{c}", f"a{c}")) / 2).alias(f"c{c}")
    layer = F.concat_ws("|", F.col("alayer"), F.when(F.col("blayer") != "", F.col("blayer")))
    return every.select("drawing_id", "ax", "ay", "bx", "by", F.when(within, "missed").otherwise("at_risk").alias("status"), F.when(within, 0.85).when(lone, 0.65).otherwise(0.7).alias("confidence"), category.alias("category"), layer.alias("layer"), middle("x"), middle("y"))


OPEN_AFTER = "select p.drawing_id, cast(p.n - coalesce(c.n, 0) as bigint) as open_after, 'at_risk' as status, 0.8 as confidence from (select drawing_id, count(*) as n from free_ends group by 1) p left join (select drawing_id, 2 * count(*) as n from gaps where status = 'within_threshold_unclosed' group by 1) c on c.drawing_id = p.drawing_id where p.n > coalesce(c.n, 0)"


@query("segments", sql=OPEN_AFTER)
def topology_records(segments: DataFrame) -> DataFrame:
    """One record by drawing that has free ends left when all gaps within the threshold are taken as closed."""
    from tesselar.operators import gaps as P

    found = P.gaps(segments)
    ends = F.when(F.col("status") == "orphan_endpoint", 1).when(F.col("status") == "within_threshold_unclosed", 0).otherwise(2)
    by = found.groupBy("drawing_id").agg(F.sum(ends).cast("bigint").alias("open_after")).where("open_after > 0")
    return by.select("drawing_id", "open_after", F.lit("at_risk").alias("status"), F.lit(0.8).alias("confidence"))


AUTO = f"(select * from records where source = 'auto' and {ACTIVE})"


@query("records", "seeds", "faces", sql=f"select d.drawing_id, coalesce(r.n, 0) as detected, coalesce(s.n, 0) as seeds, coalesce(r.n, 0) + coalesce(s.n, 0) as total from (select distinct drawing_id from records) d left join (select drawing_id, count(*) as n from {AUTO} a group by 1) r on r.drawing_id = d.drawing_id left join (select drawing_id, count(distinct face_id) as n from ({RESOLVED}) q where seed_id not in (select seed_id from ({DUPLICATE.format(RESOLVED, AUTO)}) u) group by 1) s on s.drawing_id = d.drawing_id")
def coverage_with_seeds(records: DataFrame, seeds: DataFrame, faces: DataFrame) -> DataFrame:
    """By drawing: automatic regions, seeds that resolve to a face of their own (an earlier seed keeps the face), and the regions after the merge."""
    from tesselar.plans.joins import auto_duplicates, resolved

    auto = records.where((F.col("source") == "auto") & R.is_active(F.col("status"), F.col("scope_excluded")))
    found = resolved(seeds, faces)
    ok = found.join(auto_duplicates(found, auto).select("seed_id"), "seed_id", "left_anti").groupBy("drawing_id").agg(F.countDistinct("face_id").alias("seeds"))
    by = records.select("drawing_id").distinct().join(auto.groupBy("drawing_id").agg(F.count("*").alias("detected")), "drawing_id", "left").join(ok, "drawing_id", "left").na.fill(0)
    return by.select("drawing_id", "detected", "seeds", (F.col("detected") + F.col("seeds")).alias("total"))


@query("records", "entities", sql=f"select r.drawing_id, r.face_id as id, case when m.face_id is not null then 'obstacle' else coalesce(r.geometry_role, 'partition') end as role, case when m.face_id is not null then 'detected_match' end as source from records r left join ({MATCH}) m on m.face_id = r.face_id union all select o.drawing_id, cast(o.o as bigint), 'obstacle', 'column_insert' from {PRINTS} o anti join ({MATCH}) m on m.drawing_id = o.drawing_id and m.footprint = o.o")
def classify_obstacles(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records with their role, and a row for each footprint that is no record's."""
    from tesselar.plans.joins import footprints, matched

    prints = footprints(entities)
    hit = matched(records, prints)
    own = records.join(hit.select("face_id", "footprint"), "face_id", "left")
    match = F.col("footprint").isNotNull()
    rows = own.select("drawing_id", F.col("face_id").alias("id"), F.when(match, "obstacle").otherwise(F.coalesce("geometry_role", F.lit("partition"))).alias("role"), F.when(match, "detected_match").alias("source"))
    rest = prints.join(hit.select("drawing_id", F.col("footprint").alias("o")).distinct(), ["drawing_id", "o"], "left_anti")
    return rows.unionByName(rest.select("drawing_id", F.col("o").alias("id"), F.lit("obstacle").alias("role"), F.lit("column_insert").alias("source")))


@query("pilot_sessions", sql="select session_id, engineer, minutes from pilot_sessions where session_id is not null")
def read_pilot_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("session_id is not null").select("session_id", "engineer", "minutes")


@query("grid_lines", sql="select drawing_id, line_id, cast(angle_deg as bigint) as angle_deg, position_mm from grid_lines where length_mm >= 3000")
def grid_lines(lines: DataFrame) -> DataFrame:
    """Long orthogonal lines with angle and position; the length filter comes before any clustering."""
    from tesselar.functions import geom as G

    return lines.where((F.col("length_mm") >= 3000) & G.is_orthogonal(F.col("angle_deg").cast("double"))).select("drawing_id", "line_id", F.col("angle_deg").cast("bigint").alias("angle_deg"), "position_mm")


@query("faces", "bays", sql="select bay_id, label, faces, area from (select b.bay_id, 'INT-' || b.bay_id as label, cast(count(a.face_id) as bigint) as faces, cast(coalesce(sum(a.area), 0) as bigint) as area from bays b left join assigned a on a.bay_id = b.bay_id group by 1) z")
def zone_pipeline(faces: DataFrame, bays: DataFrame) -> DataFrame:
    """Grid, assignment and zones in one plan."""
    from tesselar.operators.zones import assign_faces

    z = bays.join(assign_faces(faces, bays), "bay_id", "left").groupBy("bay_id").agg(F.count("face_id").alias("faces"), F.coalesce(F.sum("area"), F.lit(0)).alias("area"))
    return z.select("bay_id", F.concat(F.lit("INT-"), F.col("bay_id").cast("string")).alias("label"), "faces", "area")


@query("faces", "bays", sql="select f.drawing_id, sum(case when a.face_id is null then 1 else 0 end)::bigint as by_nearest, count(a.face_id)::bigint as by_overlap from faces f left join assigned a on a.face_id = f.face_id where (f.x1 - f.x0) * (f.y1 - f.y0) >= 1000000 group by 1", name="assign_methods")
def assign_methods(faces: DataFrame, bays: DataFrame) -> DataFrame:
    from tesselar.operators.zones import assign_with_nearest

    got = assign_with_nearest(faces, bays, 1_000_000)
    return got.groupBy("drawing_id").agg(F.count_if(F.col("method").endswith("nearest")).alias("by_nearest"), F.count_if(F.col("method") == "max_overlap").alias("by_overlap"))
