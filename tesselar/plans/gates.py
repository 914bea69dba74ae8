"""Zones with the area of their faces' union, readiness gates, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.operators import zones as Z
from tesselar.plans.registry import query

#: Shares in per cent and the number of labels that a detail names.
LOW_COVERAGE, DRIFT, TOLERANCE, OVERLAP = 5, 2, 0.05, 500_000
NAMED = {"zone_face_coverage": 8, "union_vs_clipped_bay": 6, "face_sum_vs_union": 6}


@query("faces", "bays", sql="select z.drawing_id, z.bay_id, z.face_ids, z.faces, z.face_sum, z.area, round(z.area * 0.15 / 1000000, 4) as volume_m3, round(z.area * 100.0 / ((b.x1 - b.x0) * (b.y1 - b.y0)), 2) as coverage_pct from zones z join bays b on b.bay_id = z.bay_id")
def zone_rollup(faces: DataFrame, bays: DataFrame) -> DataFrame:
    """Faces that overlap count once in a zone's area, which is that of the largest part of their union."""
    by, _ = Z.zones(faces, bays)
    text = F.array_join(F.transform("face_ids", lambda x: x.cast("string")), ",")
    whole = by.join(bays.select("bay_id", _area().alias("bay_area")), "bay_id")
    return whole.select("drawing_id", "bay_id", text.alias("face_ids"), "faces", "face_sum", "area", F.round(F.col("area") * 0.15 / 1e6, 4).alias("volume_m3"), F.round(F.col("area") * 100.0 / F.col("bay_area"), 2).alias("coverage_pct"))


def _area():
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def all_zones(faces: DataFrame, bays: DataFrame) -> DataFrame:
    """Every bay of every drawing; those without faces with zeros. A drawing's grid has few bays."""
    by, _ = Z.zones(faces, bays)
    grid = bays.select("bay_id", F.concat(F.lit("INT-"), F.col("bay_id").cast("string")).alias("label"), _area().alias("bay_area"))
    every = faces.select("drawing_id").distinct().withColumn("k", F.lit(0)).join(grid.withColumn("k", F.lit(0)), "k").drop("k")
    return every.join(by.drop("face_ids"), ["drawing_id", "bay_id"], "left").na.fill(0, ["faces", "face_sum", "area"])


def flags(zones: DataFrame) -> DataFrame:
    """drawing_id, gate, label, bay_id: zones that a gate finds fault with."""
    faults = F.array_compact(
        F.array(
            F.when(F.col("faces") == 0, "zone_face_coverage"),
            F.when((F.col("bay_area") > 0) & (F.col("area") * 100 < LOW_COVERAGE * F.col("bay_area")), "union_vs_clipped_bay"),
            F.when((F.col("area") > 0) & (F.abs(F.col("face_sum") - F.col("area")) * 100 > DRIFT * F.col("area")), "face_sum_vs_union"),
        )
    )
    return zones.select("drawing_id", "label", "bay_id", "faces", F.explode(faults).alias("gate"))


def named(found: DataFrame) -> DataFrame:
    """By drawing and gate: how many labels, and the first of them in the order of the bays."""
    most = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))[F.col("gate")]
    by = found.groupBy("drawing_id", "gate").agg(F.array_sort(F.collect_list(F.struct("bay_id", "label"))).alias("l"))
    return by.select("drawing_id", "gate", F.size("l").alias("n"), F.transform(F.slice("l", F.lit(1), most), lambda x: x["label"]).alias("labels"))


def against_manifest(zones: DataFrame, manifest: DataFrame) -> DataFrame:
    both = zones.join(manifest, "label")
    has = F.coalesce(F.col("area_native") > 0, F.lit(False))
    within = has & (F.abs(F.col("area") - F.col("area_native")) * 100 <= TOLERANCE * F.col("area_native"))
    return both.withColumns({"has_area": has, "within": within})


def gates(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    """drawing_id, place, gate, status, detail: six gates by drawing."""
    zones = all_zones(faces, bays)
    detail = lambda head, good, more=False: F.when(F.col("n").isNull(), good).otherwise(F.concat(F.lit(head), F.array_join("labels", ", "), F.when(F.lit(more) & (F.col("n") > 8), F.concat(F.lit(" (+"), (F.col("n") - 8).cast("string"), F.lit(" more)"))).otherwise("")))
    drawings = faces.select("drawing_id").distinct()
    found = named(flags(zones))
    texts = {"zone_face_coverage": (3, detail("Empty zones: ", "All zones have faces", True)), "union_vs_clipped_bay": (4, detail("Low union/bay coverage: ", "Union area tracks clipped bays")), "face_sum_vs_union": (5, detail("Sum != union (>2%): ", "Face areas consistent with union"))}
    out = None
    for gate, (place, text) in texts.items():
        one = drawings.join(found.where(F.col("gate") == gate).drop("gate"), "drawing_id", "left")
        one = one.select("drawing_id", F.lit(place).alias("place"), F.lit(gate).alias("gate"), F.when(F.col("n").isNull(), "PASS").otherwise("REVIEW").alias("status"), text.alias("detail"))
        out = one if out is None else out.unionByName(one)
    counts = zones.groupBy("drawing_id").agg(F.count("*").alias("z")).withColumn("k", F.lit(0)).join(manifest.groupBy(F.lit(0).alias("k")).agg(F.count("*").alias("e")), "k")
    counted = counts.select("drawing_id", F.lit(1).alias("place"), F.lit("zone_count").alias("gate"), F.when(F.col("z") == F.col("e"), "PASS").otherwise("REVIEW").alias("status"), F.concat(F.col("z").cast("string"), F.lit(" zones vs expected "), F.col("e").cast("string")).alias("detail"))
    lone = orphans(faces, bays)
    lone = lone.select("drawing_id", F.lit(2).alias("place"), F.lit("orphan_faces").alias("gate"), F.when(F.col("orphans") == 0, "PASS").otherwise("FAIL").alias("status"), F.concat(F.col("orphans").cast("string"), F.lit(" orphan(s) (max allowed 0)")).alias("detail"))
    m = against_manifest(zones, manifest).groupBy("drawing_id").agg(F.count_if("has_area").alias("has"), F.count_if("within").alias("within"))
    status = F.when(F.col("has") == 0, "SKIP").when(F.col("within") == F.col("has"), "PASS").otherwise("FAIL")
    text = F.when(F.col("has") == 0, "No manifest area_sqm values filled").otherwise(F.concat(F.col("within").cast("string"), F.lit("/"), F.col("has").cast("string"), F.lit(" within 0.05% tolerance")))
    m = m.select("drawing_id", F.lit(6).alias("place"), F.lit("manifest_area").alias("gate"), status.alias("status"), text.alias("detail"))
    return out.unionByName(counted).unionByName(lone).unionByName(m)


def orphans(faces: DataFrame, bays: DataFrame) -> DataFrame:
    """By drawing the faces, no slivers, that no bay overlaps."""
    got = Z.assign_faces(faces, bays).select("face_id", F.lit(True).alias("got"))
    return faces.join(got, "face_id", "left").groupBy("drawing_id").agg(F.count_if(F.col("got").isNull() & (_area() >= 1_000_000)).alias("orphans"))


@query("faces", "bays", "manifest_zones", sql="select drawing_id, gate, status, detail from zone_gates")
def readiness_gates(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    return gates(faces, bays, manifest).select("drawing_id", "gate", "status", "detail")


@query("faces", "bays", "manifest_zones", sql="select drawing_id, case when bool_or(status = 'FAIL') then 'FAIL' when bool_or(status = 'REVIEW') then 'REVIEW' else 'PASS' end as status from zone_gates group by 1")
def overall_gate(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    has = lambda s: F.bool_or(F.col("status") == s)
    return gates(faces, bays, manifest).groupBy("drawing_id").agg(F.when(has("FAIL"), "FAIL").when(has("REVIEW"), "REVIEW").otherwise("PASS").alias("status"))


@query("faces", "bays", "manifest_zones", sql="select drawing_id, coalesce(string_agg(case when status in ('FAIL', 'REVIEW') then gate || '=' || status || ': ' || detail end, '; ' order by place), 'All gates PASS.') as reason from zone_gates group by 1")
def overall_reason(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    text = F.concat(F.col("gate"), F.lit("="), F.col("status"), F.lit(": "), F.col("detail"))
    bad = F.array_sort(F.collect_list(F.when(F.col("status").isin("FAIL", "REVIEW"), F.struct("place", text.alias("t")))))
    by = gates(faces, bays, manifest).groupBy("drawing_id").agg(F.transform(bad, lambda x: x["t"]).alias("b"))
    return by.select("drawing_id", F.when(F.size("b") > 0, F.array_join("b", "; ")).otherwise("All gates PASS.").alias("reason"))


MET = "select d.drawing_id, o.orphans = 0 as zero_orphans, not exists (select 1 from zone_united u join zone_best a on a.drawing_id = u.drawing_id and a.bay_id = u.za join zone_best b on b.drawing_id = u.drawing_id and b.bay_id = u.zb where u.drawing_id = d.drawing_id and a.area + b.area - u.area > 500000) as zero_zone_overlaps, (select bool_and(n = bay_id) from (select bay_id, row_number() over (order by row_no, col_no, bay_id) as n from bays) l) as labels_stable, (select count(*) from bays) = (select count(*) from manifest_zones) as zone_count_match, (select count(*) from faces f where f.drawing_id = d.drawing_id and (f.x1 <= f.x0 or f.y1 <= f.y0)) = 0 as no_invalid_geometries, not exists (select 1 from bays a join bays b on a.bay_id < b.bay_id and (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 500000 and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1) as no_bay_overlaps from (select distinct drawing_id from faces) d join zone_orphans o on o.drawing_id = d.drawing_id"


@query("faces", "bays", "manifest_zones", sql=f"select *, zero_orphans and zero_zone_overlaps and labels_stable and zone_count_match and no_invalid_geometries and no_bay_overlaps as all_pass from ({MET}) c")
def milestone_criteria(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    """Six conditions by drawing, and whether all hold. Zones overlap where the union of two is smaller than their sum."""
    from tesselar.functions.geom import rect_ring, ring_validity
    from tesselar.plans.joins import bay_overlaps, zone_pairs
    from tesselar.plans.windows import bay_labels

    by, boxes = Z.zones(faces, bays)
    box = boxes.select("drawing_id", "bay_id", "x0", "y0", "x1", "y1")
    meet = zone_pairs(boxes.select("drawing_id", "face_id", F.struct("drawing_id", "bay_id").alias("zone"), "x0", "y0", "x1", "y1"), 0)
    meet = meet.select("za.drawing_id", F.col("za.bay_id").alias("za"), F.col("zb.bay_id").alias("zb"))
    both = meet.withColumn("bay_id", F.explode(F.array("za", "zb"))).join(box, ["drawing_id", "bay_id"])
    united = Z.union_area(both.drop("bay_id"), ["drawing_id", "za", "zb"])
    for side in "ab":
        united = united.join(by.select("drawing_id", F.col("bay_id").alias(f"z{side}"), F.col("area").alias(f"s{side}")), ["drawing_id", f"z{side}"])
    over = united.where(F.col("sa") + F.col("sb") - F.col("area") > OVERLAP).select("drawing_id").distinct().withColumn("over", F.lit(True))
    stable = bay_labels(bays).agg(F.bool_and(F.col("label") == F.concat(F.lit("INT-"), F.col("bay_id").cast("string"))).alias("labels_stable"))
    match = bays.agg(F.count("*").alias("z")).join(manifest.agg(F.count("*").alias("e"))).select((F.col("z") == F.col("e")).alias("zone_count_match"))  # one row each
    whole = bay_overlaps(bays).select((F.col("n") == 0).alias("no_bay_overlaps"))
    valid = faces.groupBy("drawing_id").agg(F.bool_and(ring_validity(rect_ring())).alias("no_invalid_geometries"))
    out = orphans(faces, bays).join(over, "drawing_id", "left").join(valid, "drawing_id")
    for one in (stable, match, whole):
        out = out.withColumn("k", F.lit(0)).join(one.withColumn("k", F.lit(0)), "k").drop("k")
    names = ["zero_orphans", "zero_zone_overlaps", "labels_stable", "zone_count_match", "no_invalid_geometries", "no_bay_overlaps"]
    out = out.withColumns({"zero_orphans": F.col("orphans") == 0, "zero_zone_overlaps": F.col("over").isNull()}).select("drawing_id", *names)
    every = F.col(names[0])
    for n in names[1:]:
        every = every & F.col(n)
    return out.withColumn("all_pass", every)


FLAGGED = "select f.drawing_id, f.gate, f.label, z.faces, m.area_native from (select drawing_id, gate, label, row_number() over (partition by drawing_id, gate order by bay_id) as r, named from zone_flags) f join zone_all z on z.drawing_id = f.drawing_id and z.label = f.label left join manifest_zones m on m.label = f.label where r <= named union all select drawing_id, 'manifest_area', label, faces, area_native from zone_manifest where has_area and not within"


def flagged(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    """drawing_id, gate, label, faces, area_native of the zones that a failing gate's detail names, and of all outside the manifest's tolerance."""
    zones = all_zones(faces, bays)
    own = named(flags(zones)).select("drawing_id", "gate", F.explode("labels").alias("label")).join(zones.select("drawing_id", "label", "faces"), ["drawing_id", "label"]).join(manifest, "label", "left")
    off = against_manifest(zones, manifest).where("has_area and not within").withColumn("gate", F.lit("manifest_area"))
    columns = ["drawing_id", "gate", "label", "faces", "area_native"]
    return own.select(*columns).unionByName(off.select(*columns))


@query("faces", "bays", "manifest_zones", sql=f"select drawing_id, gate, label from ({FLAGGED}) f")
def flagged_zones(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    return flagged(faces, bays, manifest).select("drawing_id", "gate", "label")


@query("faces", "bays", "manifest_zones", sql=f"select drawing_id, gate, label, case gate when 'zone_face_coverage' then case when area_native = 0 then 'Empty expected zone' else 'Engine defect' end when 'manifest_area' then 'Manifest variance' when 'union_vs_clipped_bay' then case when faces = 0 then 'Empty expected zone' else 'Geometry ambiguity' end else 'Geometry ambiguity' end as class from ({FLAGGED}) f")
def zone_issue_class(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    gate, empty = F.col("gate"), F.lit("Empty expected zone")
    kind = F.when(gate == "zone_face_coverage", F.when(F.col("area_native") == 0, empty).otherwise("Engine defect")).when(gate == "manifest_area", "Manifest variance").when((gate == "union_vs_clipped_bay") & (F.col("faces") == 0), empty).otherwise("Geometry ambiguity")
    return flagged(faces, bays, manifest).select("drawing_id", "gate", "label", kind.alias("class"))
