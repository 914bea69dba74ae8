"""Aggregations and set operations as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.functions import review as R
from tesselar.functions import text as X
from tesselar.operators import endpoints as E
from tesselar.operators import gaps as P
from tesselar.operators import zones as Z
from tesselar.plans.filters import ACTIVE, HINT
from tesselar.plans.registry import query
from tesselar.plans.reviews import ISSUES, issues
from tesselar.plans.windows import RANKED, ranked

AREA = "(x1 - x0) * (y1 - y0)"


def _area():
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


@query("entities", sql="select drawing_id, entity_type, layer, cast(count(*) as bigint) as n from entities group by grouping sets ((drawing_id, entity_type), (drawing_id, layer), (drawing_id))")
def scan_modelspace(entities: DataFrame) -> DataFrame:
    return entities.groupingSets([["drawing_id", "entity_type"], ["drawing_id", "layer"], ["drawing_id"]], "drawing_id", "entity_type", "layer").agg(F.count("*").alias("n"))


@query("entities", sql="select drawing_id, layer, cast(count(*) as bigint) as n from entities where entity_type in ('LINE', 'LWPOLYLINE', 'POLYLINE', 'ARC') group by 1, 2")
def layer_geometry_counts(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("entity_type").isin(*R.SUPPORTED)).groupBy("drawing_id", "layer").agg(F.count("*").alias("n"))


@query("segments", sql="select drawing_id, x, y, degree from points")
def endpoint_degree(segments: DataFrame) -> DataFrame:
    return E.endpoints(segments).select("drawing_id", "x", "y", "degree")


@query("segments", sql="select drawing_id, cast(count(*) as bigint) as open_ends from free_ends group by drawing_id")
def open_endpoint_count(segments: DataFrame) -> DataFrame:
    return E.free_ends(segments).groupBy("drawing_id").agg(F.count("*").alias("open_ends"))


@query("segments", sql="select drawing_id, x, y, layer from points")
def endpoint_layer(segments: DataFrame) -> DataFrame:
    return E.endpoints(segments).select("drawing_id", "x", "y", "layer")


@query("segments", sql="select drawing_id, x, y, string_agg(cast(b as varchar), ',' order by b) as bearings from (select drawing_id, x1 as x, y1 as y, case when y1 = y2 then 180 else 270 end as b from segments union all select drawing_id, x2, y2, case when y1 = y2 then 0 else 90 end from segments) e group by 1, 2, 3")
def endpoint_bearings(segments: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("bearings", lambda b: F.round(b).cast("int").cast("string")), ",")
    return E.endpoints(segments).select("drawing_id", "x", "y", text.alias("bearings"))


@query("segments", sql="select drawing_id, x, y, string_agg(cast(seg_id as varchar), ',' order by seg_id) as seg_ids from (select distinct drawing_id, x, y, seg_id from ends) e group by 1, 2, 3")
def endpoint_segments(segments: DataFrame) -> DataFrame:
    return E.endpoints(segments).select("drawing_id", "x", "y", F.array_join(F.transform("seg_ids", lambda s: s.cast("string")), ",").alias("seg_ids"))


@query("faces", sql=f"select drawing_id, cast(sum(case when {AREA} <= 0 then 1 else 0 end) as bigint) as invalid, max({AREA}) as largest, min({AREA}) as smallest, cast(sum({AREA}) as bigint) as total from faces group by 1")
def area_stats(faces: DataFrame) -> DataFrame:
    a = _area()
    return faces.groupBy("drawing_id").agg(F.count_if(a <= 0).alias("invalid"), F.max(a).alias("largest"), F.min(a).alias("smallest"), F.sum(a).alias("total"))


@query("faces", sql=f"select drawing_id, cast(count(*) as bigint) as regions, cast(sum({AREA}) as bigint) as area from faces group by rollup (drawing_id)")
def region_totals(faces: DataFrame) -> DataFrame:
    return faces.rollup("drawing_id").agg(F.count("*").alias("regions"), F.sum(_area()).alias("area"))


@query("faces", "bays", sql="select drawing_id, face_id, bay_id, area from assigned")
def assign_faces(faces: DataFrame, bays: DataFrame) -> DataFrame:
    return Z.assign_faces(faces, bays)


@query("faces", "bays", sql=f"select f.drawing_id, cast(count(*) as bigint) as total, cast(sum(case when {AREA} < 1000000 then 1 else 0 end) as bigint) as slivers, cast(sum(case when {AREA} >= 1000000 and a.face_id is not null then 1 else 0 end) as bigint) as assigned, cast(sum(case when {AREA} >= 1000000 and a.face_id is null then 1 else 0 end) as bigint) as orphans from faces f left join assigned a on a.face_id = f.face_id group by 1")
def assignment_summary(faces: DataFrame, bays: DataFrame) -> DataFrame:
    got = Z.assign_faces(faces, bays).select("face_id", F.lit(True).alias("got"))
    big = _area() >= 1_000_000
    both = faces.join(got, "face_id", "left")
    return both.groupBy("drawing_id").agg(F.count("*").alias("total"), F.count_if(~big).alias("slivers"), F.count_if(big & F.col("got").isNotNull()).alias("assigned"), F.count_if(big & F.col("got").isNull()).alias("orphans"))


@query("entities", sql="select drawing_id, entity_type, cast(count(*) as bigint) as n from entities where entity_type not in ('LINE', 'LWPOLYLINE', 'POLYLINE', 'ARC') group by 1, 2")
def unsupported_counts(entities: DataFrame) -> DataFrame:
    return entities.where(~F.col("entity_type").isin(*R.SUPPORTED)).groupBy("drawing_id", "entity_type").agg(F.count("*").alias("n"))


SUPPORT = f"select e.entity_type, e.layer, e.drawing_id, e.x, e.y, {HINT} as annotation, exists (select 1 from free_ends f where f.drawing_id = e.drawing_id and (f.x - e.x) * (f.x - e.x) + (f.y - e.y) * (f.y - e.y) <= 2250000) as near_end from (select distinct entity_type, layer, drawing_id, x, y from entities) e"


@query("entities", "segments", sql=f"select t.entity_type, t.total, t.annotation, t.candidates, t.near_end, l.layers from (select e.entity_type, cast(count(*) as bigint) as total, cast(count(*) filter (where s.annotation) as bigint) as annotation, cast(count(*) filter (where not s.annotation) as bigint) as candidates, cast(count(*) filter (where s.near_end and not s.annotation) as bigint) as near_end from entities e join ({SUPPORT}) s on s.entity_type = e.entity_type and s.layer = e.layer and s.drawing_id = e.drawing_id and s.x = e.x and s.y = e.y group by 1) t join (select entity_type, string_agg(layer || '=' || n, ', ' order by n desc, layer) as layers from (select *, row_number() over (partition by entity_type order by n desc, layer) as r from (select entity_type, layer, count(*) as n from entities group by 1, 2) c) k where r <= 10 group by 1) l on l.entity_type = t.entity_type")
def entity_support_report(entities: DataFrame, segments: DataFrame) -> DataFrame:
    """By type: entities on annotation layers, others (boundary candidates), those of them near a free end, and the ten most frequent layers."""
    from pyspark.sql import Window

    from tesselar.operators.cells import having_near

    place = entities.select("drawing_id", "x", "y").distinct()
    near = having_near(place, E.free_ends(segments), 1500).withColumn("near", F.lit(True))
    note = R.annotation_layer(F.col("layer"))
    by = entities.join(near, ["drawing_id", "x", "y"], "left").groupBy("entity_type").agg(F.count("*").alias("total"), F.count_if(note).alias("annotation"), F.count_if(~note).alias("candidates"), F.count_if(~note & F.col("near").isNotNull()).alias("near_end"))
    counts = entities.groupBy("entity_type", "layer").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.col("n").desc(), "layer"))).where("r <= 10")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("layer", F.lit("="), F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ")
    return by.join(top.groupBy("entity_type").agg(text.alias("layers")), "entity_type").select("entity_type", "total", "annotation", "candidates", "near_end", "layers")


@query("entities", sql="select drawing_id, map_from_entries(list({'k': entity_type, 'v': n} order by entity_type))::varchar as summary from (select drawing_id, entity_type, cast(count(*) as bigint) as n from entities group by 1, 2) t group by 1", name="unsupported_summary")
def unsupported_summary(entities: DataFrame) -> DataFrame:
    """The counts as a map, shown as text."""
    by = entities.groupBy("drawing_id", "entity_type").agg(F.count("*").alias("n")).groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("entity_type", "n"))).alias("e"))
    text = F.transform("e", lambda x: F.concat(x["entity_type"], F.lit("="), x["n"].cast("string")))
    return by.select("drawing_id", F.concat(F.lit("{"), F.array_join(text, ", "), F.lit("}")).alias("summary"))


@query("segments", sql="select drawing_id, status, cast(count(*) as bigint) as n from gaps group by 1, 2")
def gap_status_counts(segments: DataFrame) -> DataFrame:
    return P.gaps(segments).groupBy("drawing_id", "status").agg(F.count("*").alias("n"))


@query("segments", sql="select drawing_id, reason, cast(count(*) as bigint) as n from gap_failed group by rollup (drawing_id, reason)")
def gap_failure_counts(segments: DataFrame) -> DataFrame:
    return P.failures(P.gaps(segments)).rollup("drawing_id", "reason").agg(F.count("*").alias("n"))


@query("segments", "faces", sql="select drawing_id, cast(count(*) as bigint) as total, cast(count(*) filter (where recoverable) as bigint) as recoverable, cast(count(*) filter (where not recoverable) as bigint) as informational from (" + RANKED + ") r group by 1")
def gap_summary(segments: DataFrame, faces: DataFrame) -> DataFrame:
    hit = F.col("recoverable")
    return ranked(segments, faces).groupBy("drawing_id").agg(F.count("*").alias("total"), F.count_if(hit).alias("recoverable"), F.count_if(~hit).alias("informational"))


@query("records", sql=f"select drawing_id, cast(count(*) filter (where source = 'auto' and {ACTIVE}) as bigint) as detected, cast(count(*) filter (where source = 'seed' and {ACTIVE}) as bigint) as seed, cast(count(*) filter (where source = 'manual' and {ACTIVE}) as bigint) as manual, cast(count(*) filter (where status = 'deleted') as bigint) as deleted, cast(count(*) filter (where scope_excluded) as bigint) as excluded, cast(count(*) as bigint) as total from records group by 1")
def record_counts(records: DataFrame) -> DataFrame:
    live = R.is_active(F.col("status"), F.col("scope_excluded"))
    of = lambda s: F.count_if(live & (F.col("source") == s))
    return records.groupBy("drawing_id").agg(of("auto").alias("detected"), of("seed").alias("seed"), of("manual").alias("manual"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.expr("scope_excluded")).alias("excluded"), F.count("*").alias("total"))


YN = "case when upper(trim({0})) = 'Y' then 1.0 when upper(trim({0})) = 'N' then 0.0 end"


@query("pilot_sessions", sql=f"select round(avg({YN.format('saved_ok')}), 4) as saved, round(avg({YN.format('export_ok')}), 4) as exported, round(least(avg({YN.format('saved_ok')}), avg({YN.format('export_ok')})), 4) as worse, bool_or(upper(trim(useful)) = 'Y') as useful, case when least(avg({YN.format('saved_ok')}), avg({YN.format('export_ok')})) >= 0.9 then 'exit' else 'continue' end as decision from pilot_sessions where session_id is not null")
def pilot_exit(sessions: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(X.yn_flag(F.col(c)).cast("double"))
    worse = F.least("saved", "exported")
    r = sessions.where("session_id is not null").agg(rate("saved_ok").alias("saved"), rate("export_ok").alias("exported"), F.bool_or(X.yn_flag(F.col("useful"))).alias("useful"))
    return r.select(F.round("saved", 4).alias("saved"), F.round("exported", 4).alias("exported"), F.round(worse, 4).alias("worse"), "useful", F.when(worse >= 0.9, "exit").otherwise("continue").alias("decision"))


@query("faces", "records", sql=f"select f.drawing_id, cast(count(*) as bigint) as reference, cast(count(r.face_id) as bigint) as detected, round(100.0 * count(r.face_id) / count(*), 2) as recall_pct, (100.0 * count(r.face_id) / count(*) > 90) as on_target from faces f left join (select face_id from records where source = 'auto' and {ACTIVE}) r on r.face_id = f.face_id group by 1")
def detection_recall(faces: DataFrame, records: DataFrame) -> DataFrame:
    """Regions of the reference (the faces) that detection has, in per cent; the target is above 90."""
    live = records.where((F.col("source") == "auto") & R.is_active(F.col("status"), F.col("scope_excluded"))).select("face_id", F.lit(1).alias("hit"))
    share = F.count("hit") * 100.0 / F.nullif(F.count("*"), F.lit(0))
    return faces.join(live, "face_id", "left").groupBy("drawing_id").agg(F.count("*").alias("reference"), F.count("hit").alias("detected"), F.round(share, 2).alias("recall_pct"), (share > 90).alias("on_target"))


ERROR = "abs((n.x1 - n.x0) * (n.y1 - n.y0) - (f.x1 - f.x0) * (f.y1 - f.y0)) * 100.0 / ((f.x1 - f.x0) * (f.y1 - f.y0))"


@query("faces", "redrawn", sql=f"select drawing_id, round(max(e), 4) as worst, round(avg(e), 4) as mean, round(median(e), 4) as middle, round(100.0 * count(*) filter (where e <= 0.05) / count(*), 2) as share from (select f.drawing_id, {ERROR} as e from faces f join redrawn n on n.face_id = f.face_id) t group by 1")
def area_error_stats(faces: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Area error of detected regions (the second drawing's) against the reference's, in per cent; the share within 0.05."""
    ring = lambda p: G.ring_area(G.rect_ring(f"{p}x0", f"{p}y0", f"{p}x1", f"{p}y1"))
    box = ["x0", "y0", "x1", "y1"]
    both = faces.select("drawing_id", "face_id", *(F.col(c).alias(f"f{c}") for c in box)).join(redrawn.select("face_id", *(F.col(c).alias(f"n{c}") for c in box)), "face_id")
    e = F.abs(ring("n") - ring("f")) * 100.0 / F.nullif(ring("f"), F.lit(0.0))
    both = both.select("drawing_id", e.alias("e"))
    return both.groupBy("drawing_id").agg(F.round(F.max("e"), 4).alias("worst"), F.round(F.avg("e"), 4).alias("mean"), F.round(F.median("e"), 4).alias("middle"), F.round(F.count_if(F.col("e") <= 0.05) * 100.0 / F.count("*"), 2).alias("share"))


@query("faces", "bays", "manifest_zones", sql="select drawing_id, greatest(0, (select count(*) from manifest_zones) - count(*) filter (where faces > 0)) as gap from zone_all group by 1")
def count_gap(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    """Zones that the manifest expects and detection does not fill, by drawing."""
    from tesselar.plans.gates import all_zones

    expected = manifest.groupBy(F.lit(0).alias("k")).agg(F.count("*").alias("expected"))
    found = all_zones(faces, bays).groupBy("drawing_id").agg(F.count_if(F.col("faces") > 0).alias("n")).withColumn("k", F.lit(0))
    return found.join(expected, "k").select("drawing_id", F.greatest(F.lit(0).cast("bigint"), F.col("expected") - F.col("n")).alias("gap"))


KINDS = ["open_boundary", "self_intersection", "tiny_polygon", "duplicate", "overlap"]


@query("records", sql="select d.drawing_id, " + ", ".join(f"cast(count(*) filter (where i.issue = '{k}') as bigint) as {k}" for k in KINDS) + f", (count(*) filter (where i.issue in ('open_boundary', 'self_intersection')) = 0) as ok from (select distinct drawing_id from records) d left join ({ISSUES}) i on i.drawing_id = d.drawing_id group by 1")
def validation_summary(records: DataFrame) -> DataFrame:
    """Issues by kind and drawing; a drawing is fine without open and crossing rings."""
    both = records.select("drawing_id").distinct().join(issues(records), "drawing_id", "left")
    of = lambda k: F.count_if(F.coalesce(F.col("issue") == k, F.lit(False)))
    return both.groupBy("drawing_id").agg(*(of(k).alias(k) for k in KINDS), (of("open_boundary") + of("self_intersection") == 0).alias("ok"))


@query("entities", "segments", "faces", "layer_config", sql="select e.drawing_id, e.entities, e.layers, e.boundary, coalesce(c.configured, 0) as configured, coalesce(s.open_before, 0) as open_before, coalesce(g.closed, 0) as gaps_closed, coalesce(s.open_before, 0) - 2 * coalesce(g.closed, 0) as open_after, coalesce(f.regions, 0) as regions, f.largest, f.smallest, f.total from (select drawing_id, cast(count(*) as bigint) as entities, cast(count(distinct layer) as bigint) as layers, cast(count(*) filter (where entity_type <> 'INSERT') as bigint) as boundary from entities group by 1) e left join (select e.drawing_id, cast(count(*) as bigint) as configured from entities e where e.entity_type <> 'INSERT' and exists (select 1 from layer_config c where c.drawing_id = e.drawing_id and upper(c.layer) = upper(e.layer)) group by 1) c on c.drawing_id = e.drawing_id left join (select drawing_id, cast(count(*) as bigint) as open_before from free_ends group by 1) s on s.drawing_id = e.drawing_id left join (select drawing_id, cast(count(*) as bigint) as closed from gaps where status = 'within_threshold_unclosed' group by 1) g on g.drawing_id = e.drawing_id left join (select drawing_id, cast(count(*) as bigint) as regions, max((x1 - x0) * (y1 - y0)) as largest, min((x1 - x0) * (y1 - y0)) as smallest, cast(sum((x1 - x0) * (y1 - y0)) as bigint) as total from faces group by 1) f on f.drawing_id = e.drawing_id")
def drawing_diagnostics(entities: DataFrame, segments: DataFrame, faces: DataFrame, config: DataFrame) -> DataFrame:
    """The wide row of a drawing: entities of all and of the configured layers, free ends before and after closing, regions and their areas."""
    up = F.upper("layer").alias("up")
    own = entities.where(F.col("entity_type").isin(*R.SUPPORTED))
    e = entities.groupBy("drawing_id").agg(F.count("*").alias("entities"), F.countDistinct("layer").alias("layers"), F.count_if(F.col("entity_type").isin(*R.SUPPORTED)).alias("boundary"))
    c = own.select("drawing_id", up).join(config.select("drawing_id", up).distinct(), ["drawing_id", "up"], "left_semi").groupBy("drawing_id").agg(F.count("*").alias("configured"))
    found = P.gaps(segments)
    ends = F.sum(F.when(F.col("status") == "orphan_endpoint", 1).otherwise(2)).cast("bigint")
    g = found.groupBy("drawing_id").agg(ends.alias("open_before"), F.count_if(F.col("status") == "within_threshold_unclosed").alias("gaps_closed"))
    r = faces.groupBy("drawing_id").agg(F.count("*").alias("regions"), F.max(_area()).alias("largest"), F.min(_area()).alias("smallest"), F.sum(_area()).alias("total"))
    out = e.join(c, "drawing_id", "left").join(g, "drawing_id", "left").join(r, "drawing_id", "left").na.fill(0, ["configured", "open_before", "gaps_closed", "regions"])
    return out.select("drawing_id", "entities", "layers", "boundary", "configured", "open_before", "gaps_closed", (F.col("open_before") - 2 * F.col("gaps_closed")).alias("open_after"), "regions", "largest", "smallest", "total")


SUITE = f"select d.drawing_id, coalesce(b.n, 0) as baseline, coalesce(r.n, 0) as detected from (select drawing_id from faces union select drawing_id from records) d left join (select drawing_id, count(*) as n from faces where (x1 - x0) * (y1 - y0) >= 1000000 group by 1) b on b.drawing_id = d.drawing_id left join (select drawing_id, count(*) as n from records where {ACTIVE} group by 1) r on r.drawing_id = d.drawing_id"


def suite(faces: DataFrame, records: DataFrame) -> DataFrame:
    """Regions by drawing against a baseline: what the reference plan has of faces that are no slivers."""
    base = faces.where(_area() >= 1_000_000).groupBy("drawing_id").agg(F.count("*").alias("baseline"))
    now = records.where(R.is_active(F.col("status"), F.col("scope_excluded"))).groupBy("drawing_id").agg(F.count("*").alias("detected"))
    every = faces.select("drawing_id").union(records.select("drawing_id")).distinct()
    return every.join(base, "drawing_id", "left").join(now, "drawing_id", "left").na.fill(0)


@query("faces", "records", sql=f"select cast(count(*) as bigint) as drawings, cast(sum(baseline) as bigint) as baseline, cast(sum(detected) as bigint) as detected, (sum(detected) >= sum(baseline)) as held from ({SUITE}) s")
def suite_totals(faces: DataFrame, records: DataFrame) -> DataFrame:
    return suite(faces, records).agg(F.count("*").alias("drawings"), F.sum("baseline").alias("baseline"), F.sum("detected").alias("detected"), (F.sum("detected") >= F.sum("baseline")).alias("held"))


@query("faces", "records", sql=f"select *, (detected >= baseline) as held from ({SUITE}) s")
def suite_regression(faces: DataFrame, records: DataFrame) -> DataFrame:
    return suite(faces, records).withColumn("held", F.col("detected") >= F.col("baseline"))


@query("faces", "bays", sql="select coalesce(a.drawing_id, z.drawing_id) as drawing_id, cast(count(*) filter (where a.face_id is null or z.face_id is null) as bigint) as mismatches, cast(count(*) as bigint) as faces from (select drawing_id, face_id from assigned) a full outer join (select drawing_id, face_id from zone_boxes) z on z.face_id = a.face_id group by 1")
def assigned_equals_zones(faces: DataFrame, bays: DataFrame) -> DataFrame:
    """By drawing: faces that are assigned but in no zone, or the other way round. Zones leave slivers out, so these show here."""
    got = Z.assign_faces(faces, bays).select("face_id", F.col("drawing_id").alias("da"))
    listed = Z.zones(faces, bays)[0].select(F.col("drawing_id").alias("dz"), F.explode("face_ids").alias("face_id"))
    both = got.join(listed, "face_id", "full_outer")
    return both.groupBy(F.coalesce("da", "dz").alias("drawing_id")).agg(F.count_if(F.col("da").isNull() | F.col("dz").isNull()).alias("mismatches"), F.count("*").alias("faces"))


# ---- set operations ---------------------------------------------------------------------------


@query("segments", "entities", sql="select layer, cast(min(o) as bigint) as place from (select distinct layer, 1 as o from segments union all select distinct layer, 2 from entities) t group by layer")
def layer_union_ordered(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """Configured layers (of segments) before candidates (of entities); the first place counts."""
    both = segments.select("layer", F.lit(1).cast("bigint").alias("place")).distinct().unionByName(entities.select("layer", F.lit(2).cast("bigint").alias("place")).distinct())
    return both.groupBy("layer").agg(F.min("place").alias("place"))


@query("bays", "manifest_zones", sql="select concat('INT-', bay_id) as label from bays union select label from manifest_zones")
def label_union(bays: DataFrame, zones: DataFrame) -> DataFrame:
    return bays.select(F.concat(F.lit("INT-"), F.col("bay_id").cast("string")).alias("label")).union(zones.select("label")).distinct()


@query("faces", "bays", sql="select face_id from faces except select face_id from assigned")
def unassigned_faces(faces: DataFrame, bays: DataFrame) -> DataFrame:
    return faces.select("face_id").join(Z.assign_faces(faces, bays).select("face_id"), "face_id", "left_anti")


@query("segments", sql="select c.drawing_id, c.ax, c.ay, c.bx, c.by_ as \"by\" from candidate_pairs c where c.d2 > 40000 and not exists (select 1 from candidate_pairs t where t.d2 <= 40000 and t.drawing_id = c.drawing_id and ((t.ax = c.ax and t.ay = c.ay) or (t.bx = c.ax and t.by_ = c.ay) or (t.ax = c.bx and t.ay = c.by_) or (t.bx = c.bx and t.by_ = c.by_)))")
def pair_reject_used(segments: DataFrame) -> DataFrame:
    c = E.gap_candidates(segments, 500.0)
    return E.without_used(c.where("d2 > 40000"), c.where("d2 <= 40000")).select("drawing_id", "ax", "ay", "bx", "by")


