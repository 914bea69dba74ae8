"""Scans, predicates and text expressions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import review as R
from tesselar.functions import text as X
from tesselar.plans.registry import query

L = "bigint"
ACTIVE = "coalesce(status, 'active') <> 'deleted' and not coalesce(scope_excluded, false)"
PARTITION = f"{ACTIVE} and coalesce(geometry_role, 'partition') <> 'obstacle'"
STRUCT = "upper({0}) in ('S-FNDN-1', 'S-BEAM-1', 'S-BEAM-2', 'A-WALL', 'A-WALL-2', 'A-WALL-3')"
HINT = "regexp_matches(upper(layer), 'DIM|TEXT|HATCH|DEFPOINT|ANNOTATION|NOTE|GRID|AXIS|TITLE|VIEWPORT|NO_PLOT')"


@query("entities", sql="select drawing_id, entity_type, layer, cast(count(*) as bigint) as n from entities where upper(layer) in ('WALL', 'S-FNDN-1', 'S-COLS') and upper(layer) not in ('S-COLS') and entity_type in ('LINE', 'LWPOLYLINE', 'POLYLINE', 'ARC') group by 1, 2, 3")
def entity_filter(entities: DataFrame) -> DataFrame:
    kept = entities.where(F.col("entity_type").isin(*R.SUPPORTED) & R.layer_kept(F.col("layer"), ["wall", "s-fndn-1", "S-COLS"], ["s-cols"]))
    return kept.groupBy("drawing_id", "entity_type", "layer").agg(F.count("*").alias("n"))


@query("entities", sql="select drawing_id, (entity_type in ('LINE', 'LWPOLYLINE', 'POLYLINE', 'ARC')) as supported, cast(count(*) as bigint) as n from entities group by 1, 2")
def all_segments_quarantine(entities: DataFrame) -> DataFrame:
    return entities.groupBy("drawing_id", F.col("entity_type").isin(*R.SUPPORTED).alias("supported")).agg(F.count("*").alias("n"))


@query("segments", sql="select seg_id, (x2 - x1 + y2 - y1) * 0.001 as length_m from segments where x2 - x1 + y2 - y1 > 600")
def unit_scale(segments: DataFrame) -> DataFrame:
    length = F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")
    return segments.where(length > 600).select("seg_id", (length * R.unit_scale(F.lit("mm"))).alias("length_m"))


@query("records", sql=f"select face_id, ({ACTIVE}) as active, ({PARTITION}) as is_partition, (coalesce(geometry_role, 'partition') = 'obstacle') as obstacle from records")
def is_active(records: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("status", "scope_excluded", "geometry_role")]
    return records.select("face_id", R.is_active(*c[:2]).alias("active"), R.is_partition(*c).alias("is_partition"), R.is_obstacle(c[2]).alias("obstacle"))


@query("records", sql=f"select face_id, area_native from records where {PARTITION}")
def is_partition(records: DataFrame) -> DataFrame:
    return records.where(R.is_partition(F.col("status"), F.col("scope_excluded"), F.col("geometry_role"))).select("face_id", "area_native")


@query("records", sql=f"select face_id, area_native from records where {ACTIVE} and coalesce(geometry_role, 'partition') = 'obstacle'")
def is_obstacle(records: DataFrame) -> DataFrame:
    return records.where(R.is_active(F.col("status"), F.col("scope_excluded")) & R.is_obstacle(F.col("geometry_role"))).select("face_id", "area_native")


FILTERS = {
    "auto": "source = 'auto'",
    "recovered": "source = 'seed'",
    "manual": "source = 'manual'",
    "deleted": "status = 'deleted'",
    "large": "area_native > 4000000",
    "small": "area_native < 500000",
    "approved": "lower(trim(review)) = 'approved'",
    "pending": "lower(trim(review)) = 'pending'",
    "rejected": "lower(trim(review)) = 'rejected'",
    "all": "true",
}


@query("records", sql=" union all ".join(f"select '{k}' as filter, face_id from records where ({v}) and (zone like '%-1%' or cast(face_id as varchar) like '%7%')" for k, v in FILTERS.items()))
def polygon_filter_search(records: DataFrame) -> DataFrame:
    """Ten named filters, each with a search on zone and id: one pass, one row for each filter that a record meets."""
    names = F.array_compact(F.array(*(F.when(F.expr(v), k) for k, v in FILTERS.items())))
    found = records.where(F.col("zone").contains("-1") | F.col("face_id").cast("string").contains("7"))
    return found.select(F.explode(names).alias("filter"), "face_id")


@query("faces", sql="select face_id from faces where (x1 - x0) * (y1 - y0) >= 1000000")
def min_area_filter(faces: DataFrame, least: int = 1_000_000, exhaustive: bool = False) -> DataFrame:
    """In exhaustive mode small faces stay too."""
    return faces.where(F.lit(exhaustive) | ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least)).select("face_id")


@query("faces", sql="select drawing_id, cast(count(*) as bigint) as faces, cast(sum(case when (x1 - x0) * (y1 - y0) < 1000000 then 1 else 0 end) as bigint) as slivers from faces group by 1")
def sliver_filter(faces: DataFrame) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return faces.groupBy("drawing_id").agg(F.count("*").alias("faces"), F.count_if(area < 1_000_000).alias("slivers"))


SLAB = "(x0 + x1) between 10000 and 80000 and (y0 + y1) between 10000 and 80000"


@query("faces", sql=f"select face_id, drawing_id from faces where {SLAB}")
def slab_centroid_filter(faces: DataFrame) -> DataFrame:
    """Faces whose centroid a slab from 5 to 40 m covers (twice the centroid, to stay in integers)."""
    inside = [(F.col(f"{a}0") + F.col(f"{a}1")).between(10_000, 80_000) for a in "xy"]
    return faces.where(inside[0] & inside[1]).select("face_id", "drawing_id")


@query("records", sql=f"select face_id, (not ({SLAB})) as scope_excluded from records")
def scope_clip(records: DataFrame) -> DataFrame:
    inside = [(F.col(f"{a}0") + F.col(f"{a}1")).between(10_000, 80_000) for a in "xy"]
    return records.select("face_id", (~(inside[0] & inside[1])).alias("scope_excluded"))


@query("records", sql="select face_id, false as scope_excluded from records where scope_excluded")
def scope_clear(records: DataFrame) -> DataFrame:
    return records.where("scope_excluded").withColumn("scope_excluded", F.lit(False)).select("face_id", "scope_excluded")


@query("seeds", sql="select seed_id, (row_number() over (partition by drawing_id, x - x % 100, y - y % 100 order by seed_id) = 1) as valid from seeds")
def seed_validity(seeds: DataFrame) -> DataFrame:
    """A later seed at the rounded place of an earlier one is rejected; seeds come with finite numbers."""
    key = [F.col(c) - F.col(c) % 100 for c in "xy"]
    return seeds.select("seed_id", (F.row_number().over(Window.partitionBy("drawing_id", *key).orderBy("seed_id")) == 1).alias("valid"))


@query("entities", sql=f"select layer, {HINT} as annotation, cast(count(*) as bigint) as n from entities group by 1, 2")
def annotation_layer(entities: DataFrame) -> DataFrame:
    return entities.groupBy("layer", R.annotation_layer(F.col("layer")).alias("annotation")).agg(F.count("*").alias("n"))


PAIR_SQL = f"""{STRUCT.format('a')} and {STRUCT.format('b')} and (a = b
  or (a like 'S-FNDN-1%' and b like 'S-BEAM%') or (a like 'S-BEAM%' and b like 'S-FNDN-1%')
  or (a like 'S-FNDN-1%' and b like 'A-WALL%') or (a like 'A-WALL%' and b like 'S-FNDN-1%')
  or (a like 'S-BEAM%' and b like 'A-WALL%') or (a like 'A-WALL%' and b like 'S-BEAM%'))"""


@query("segments", sql=f"select a, b, ({PAIR_SQL}) as allowed from (select distinct layer as a from segments) p join (select distinct layer as b from segments) q on a <= b")
def tier2_layer_pair(segments: DataFrame) -> DataFrame:
    """All pairs of the distinct layer names: a drawing office has some dozens of them, whatever the number of segments."""
    names = segments.groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_set("layer")).alias("all"))
    pairs = names.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a <= b")
    return pairs.select("a", "b", R.tier2_layer_pair(F.col("a"), F.col("b")).alias("allowed"))


@query("faces", sql="select face_id from faces where x0 + x1 between 20000 and 60000 and y0 + y1 between 20000 and 60000")
def polygons_in_rect(faces: DataFrame) -> DataFrame:
    return faces.where((F.col("x0") + F.col("x1")).between(20_000, 60_000) & (F.col("y0") + F.col("y1")).between(20_000, 60_000)).select("face_id")


@query("faces", sql="select face_id from faces where exists (select 1 from (values (x0, y0), (x1, y0), (x1, y1), (x0, y1)) v(px, py) where px between 10000 and 20000 and py between 10000 and 20000) or ((x0 + x1) between 20000 and 40000 and (y0 + y1) between 20000 and 40000)")
def bbox_filter(faces: DataFrame) -> DataFrame:
    """Any vertex, or the centre, inside the bounds; the box columns prune first."""
    from tesselar.functions.geom import rect_ring

    near = faces.where("x1 >= 10000 and x0 <= 20000 and y1 >= 10000 and y0 <= 20000")
    vertex = F.exists(rect_ring(), lambda p: p["x"].between(10_000, 20_000) & p["y"].between(10_000, 20_000))
    centre = (F.col("x0") + F.col("x1")).between(20_000, 40_000) & (F.col("y0") + F.col("y1")).between(20_000, 40_000)
    return near.where(vertex | centre).select("face_id")


@query("records", sql="select face_id, case when lower(trim(review)) = 'approved' then 'approved' when lower(trim(review)) = 'needs-review' then 'needs_review' else lower(trim(review)) end as status, (lower(trim(review)) <> 'approved') as engineer_may_set from records")
def review_status_rule(records: DataFrame) -> DataFrame:
    status = R.normal_status(F.col("review"))
    return records.select("face_id", status.alias("status"), (status != "approved").alias("engineer_may_set"))


@query("bays", "manifest_zones", sql="select b.bay_id, coalesce(case when b.bay_id % 4 = 0 then 'explicit' end, case when m.label is not null and b.bay_id % 3 = 0 then 'manifest' end, case when b.bay_id % 2 = 0 then 'config' end, 'auto') as profile from bays b left join manifest_zones m on m.label = concat('INT-', cast(b.bay_id as varchar))")
def profile_resolve(bays: DataFrame, zones: DataFrame) -> DataFrame:
    """Explicit, then manifest, then config, then the default."""
    both = bays.join(zones, zones["label"] == F.concat(F.lit("INT-"), bays["bay_id"].cast("string")), "left")
    pick = F.coalesce(F.when(F.col("bay_id") % 4 == 0, "explicit"), F.when(F.col("label").isNotNull() & (F.col("bay_id") % 3 == 0), "manifest"), F.when(F.col("bay_id") % 2 == 0, "config"), F.lit("auto"))
    return both.select("bay_id", pick.alias("profile"))


@query("seeds", "records", sql=f"select seed_id, case when not (x between 5000 and 40000 and y between 5000 and 40000) then 'outside boundary' when exists (select 1 from records f where f.geometry_role = 'obstacle' and {ACTIVE} and f.drawing_id = s.drawing_id and s.x between f.x0 and f.x1 and s.y between f.y0 and f.y1) then 'inside obstacle' else 'ok' end as reason from seeds s")
def recovery_point_check(seeds: DataFrame, records: DataFrame) -> DataFrame:
    """A recovery point must lie in the applied boundary and in no active obstacle."""
    from tesselar.operators.cells import points_in_boxes

    obstacles = records.where(R.is_obstacle(F.col("geometry_role")) & R.is_active(F.col("status"), F.col("scope_excluded"))).select("drawing_id", "x0", "y0", "x1", "y1")
    hit = points_in_boxes(seeds, obstacles, 4000).select("seed_id").distinct().withColumn("hit", F.lit(True))
    inside = F.col("x").between(5000, 40_000) & F.col("y").between(5000, 40_000)
    return seeds.join(hit, "seed_id", "left").select("seed_id", F.when(~inside, "outside boundary").when(F.col("hit"), "inside obstacle").otherwise("ok").alias("reason"))


# ---- text -------------------------------------------------------------------------------------


@query("records", sql="select face_id, printf('%s' || chr(10) || 'Area: %.2f m2' || chr(10) || 'Vol: %.2f m3', zone, (area_native // 40000) / 25.0, (area_native // 40000) / 100.0) as label from records")
def region_label_text(records: DataFrame) -> DataFrame:
    units = F.floor(F.col("area_native") / 40000)  # exact in two decimals
    return records.select("face_id", X.region_label_text(F.col("zone"), units / 25.0, units / 100.0).alias("label"))


@query("records", sql="select zone, cast(split_part(zone, '-', 2) as bigint) as number, zone || ';' || cast(n as varchar) as text from (select zone, cast(count(*) as bigint) as n from records group by zone) z")
def label_number(records: DataFrame) -> DataFrame:
    zones = records.groupBy("zone").agg(F.count("*").alias("n"))
    return zones.select("zone", X.label_number(F.col("zone")).alias("number"), F.concat_ws(";", "zone", F.col("n").cast("string")).alias("text"))


@query("records", sql="select zone, cast(sum(area_native) as bigint) as area, printf('%s' || chr(10) || 'Bays: %d' || chr(10) || 'Area: %.2f m2' || chr(10) || 'Vol: %.2f m3', zone, cast(count(*) as bigint), sum(area_native // 1000000) / 4.0, sum(area_native // 1000000) / 2.0) as label from records group by zone")
def zone_label_text(records: DataFrame) -> DataFrame:
    m2 = F.sum(F.floor(F.col("area_native") / 1_000_000)).cast("double")
    zones = records.groupBy("zone").agg(F.sum("area_native").alias("area"), F.count("*").alias("bays"), m2.alias("m2"))
    return zones.select("zone", "area", X.zone_label_text(F.col("zone"), F.col("bays"), F.col("m2") / 4, F.col("m2") / 2).alias("label"))


@query("bays", sql="select bay_id, regexp_matches('zones INT-1, INT-18 and INT-7', '(^|[^0-9A-Za-z-])INT-' || bay_id || '($|[^0-9A-Za-z-])') as named from bays")
def label_in_text(bays: DataFrame) -> DataFrame:
    label = F.concat(F.lit("INT-"), F.col("bay_id").cast("string"))
    return bays.select("bay_id", X.label_in_text(label, F.lit("zones INT-1, INT-18 and INT-7")).alias("named"))


@query("segments", sql="select layer || '|' || upper(layer) as pair, 'Gap status: ' || layer || '; distance=' || cast(cast(max(seg_id % 800) as bigint) as varchar) || case when layer like 'S%' then '; failure_reason=bearing mismatch' else '' end as reason, case when length(repeat(layer, 9)) > 60 then left(repeat(layer, 9), 60) || '…' else repeat(layer, 9) end as short from segments group by layer")
def layer_pair_text(segments: DataFrame) -> DataFrame:
    by = segments.groupBy("layer").agg(F.max(F.col("seg_id") % 800).alias("d"))
    name = F.col("layer")
    reason = X.gap_reason_text(name, F.col("d"), F.when(name.startswith("S"), "bearing mismatch"))
    return by.select(X.layer_pair_text(name, F.upper(name)).alias("pair"), reason.alias("reason"), X.truncate_ellipsis(F.repeat(name, 9)).alias("short"))


@query("records", sql="select drawing_id, string_agg(source, ',' order by source) as types from (select distinct drawing_id, source from records) r group by drawing_id")
def entity_type_list(records: DataFrame) -> DataFrame:
    return records.groupBy("drawing_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("types"))


@query("pilot_sessions", sql="select session_id, case when upper(trim(saved_ok)) = 'Y' then true when upper(trim(saved_ok)) = 'N' then false end as saved from pilot_sessions where session_id is not null")
def yn_flag(sessions: DataFrame) -> DataFrame:
    return sessions.where("session_id is not null").select("session_id", X.yn_flag(F.col("saved_ok")).alias("saved"))


@query("review_events", sql="select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from review_events")
def utc_now_iso(events: DataFrame) -> DataFrame:
    """The clock is a parameter: here each event's own time."""
    return events.select("event_id", X.utc_iso(F.col("ts")).alias("at"))


@query("segments", sql="select seg_id, lower(layer) || '.dxf' as name from segments")
def normalize_source_name(segments: DataFrame) -> DataFrame:
    path = F.concat(F.lit("C:\\Plans\\/"), F.col("layer"), F.lit(".DXF"))
    return segments.select("seg_id", X.normalize_source_name(path).alias("name"))


@query("records", sql="select face_id, json_object('zone', zone, 'area', area_native) as evidence from records")
def evidence_json(records: DataFrame) -> DataFrame:
    return records.select("face_id", F.to_json(F.struct("zone", F.col("area_native").alias("area"))).alias("evidence"))
