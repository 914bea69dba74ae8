"""Sources and sinks as queries: text made from the tables is parsed back, reports are given as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.functions import review as R
from tesselar.operators.state import shared
from tesselar.plans.filters import PARTITION
from tesselar.plans.registry import query
from tesselar.sources import documents as D
from tesselar.sources import sinks as S
from tesselar.sources import tags as T


def written(segments: DataFrame) -> str:
    """Folder of the plan's segments and layers as tag files."""
    from tesselar.operators.state import Steps

    own = segments.withColumnRenamed("drawing_id", "drawing")
    path = f"{Steps(segments.sparkSession).path}/drawings"
    S.write_tag_files(S.line_tags(own), path, own.select("drawing", "layer"))
    return path


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Tags of the files below a folder that ``write_tag_files`` has made."""
    return T.read_tags(spark, path, "*.txt")


def number(of: str = "drawing") -> Column:
    return F.regexp_extract(of, r"drawing=(\d+)", 1).cast("bigint").alias("drawing")


def tags_of(segments: DataFrame) -> DataFrame:
    """The plan written as tag files and read again, once for all queries of a session."""
    return shared("plan-tags", lambda s: read_back(s.sparkSession, written(s)), segments)


def rings_of(faces: DataFrame) -> DataFrame:
    from tesselar.operators.state import Steps

    path = f"{Steps(faces.sparkSession).path}/rings"
    S.write_tag_files(S.ring_tags(faces.select(F.col("drawing_id").alias("drawing"), G.rect_ring().alias("ring"))), path)
    return read_back(faces.sparkSession, path)


@query("segments", sql="select drawing_id as drawing, layer, cast(x1 as double) as x1, cast(y1 as double) as y1, cast(x2 as double) as x2, cast(y2 as double) as y2 from segments")
def dxf_entities(segments: DataFrame) -> DataFrame:
    return T.segments(T.entities(tags_of(segments))).select(number(), "layer", "x1", "y1", "x2", "y2")


@query("segments", sql="select distinct drawing_id as drawing, layer as name from segments")
def dxf_layers(segments: DataFrame) -> DataFrame:
    return T.layers(tags_of(segments)).select(number(), "name").distinct()


@query("segments", sql="select drawing_id as drawing, layer, cast(count(*) as bigint) as n from segments group by 1, 2")
def tagged_segments(segments: DataFrame) -> DataFrame:
    return T.segments(T.entities(tags_of(segments))).groupBy(number(), "layer").agg(F.count("*").alias("n"))


@query("faces", sql="select drawing_id as drawing, cast(count(*) * 4 as bigint) as n from faces group by 1")
def entity_to_segments(faces: DataFrame) -> DataFrame:
    """Closed outlines of four points give four segments each."""
    return T.segments(T.entities(rings_of(faces))).groupBy(number()).agg(F.count("*").alias("n"))


@query("faces", sql="select drawing_id as drawing, cast(count(*) as bigint) as rings, cast(sum((x1 - x0) * (y1 - y0)) as double) as area from faces group by 1")
def polyline_tag_export(faces: DataFrame) -> DataFrame:
    """Rings written as tag files and read again."""
    back = T.entities(rings_of(faces)).where("closed")
    return back.groupBy(number()).agg(F.count("*").alias("rings"), F.sum(G.ring_area(F.col("vertices"))).alias("area"))


def block_tables(placed: DataFrame, blocks: DataFrame, nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inserts, entities of blocks and blocks in blocks of the plan: outlines, lines around one, and corners of two lines."""
    inserts = placed.where("is_column").select("insert_id", "block", "x", "y", "scale", "angle").distinct()
    w, h, o = F.col("w"), F.col("h"), F.lit(0)
    line = lambda closed, *p: F.struct(F.lit(closed).alias("closed"), F.array(*(G.point(x, y) for x, y in p)).alias("vertices"))
    corners = ((o, o), (w, o), (w, h), (o, h))
    sides = [line(False, corners[k], corners[(k + 1) % 4]) for k in range(4)]
    shapes = F.when(F.col("kind") == 0, F.array(line(True, *corners))).when(F.col("kind") == 1, F.array(*sides)).when(F.col("kind") == 2, F.array(*sides[:2]))
    entities = blocks.select("block", F.posexplode(shapes).alias("entity", "e")).select("block", "entity", "e.closed", "e.vertices")
    return inserts, entities, nested.withColumn("scale", F.lit(1))


_POINTS = "select block, unnest(case kind when 0 then [0, 0, 0, 0] when 1 then [0, 0, 1, 1, 2, 2, 3, 3] when 2 then [0, 0, 1, 1] else [] end) as entity, unnest(case kind when 0 then [0, w, w, 0] when 1 then [0, w, w, w, w, 0, 0, 0] when 2 then [0, w, w, w] else [] end) as px, unnest(case kind when 0 then [0, 0, h, h] when 1 then [0, 0, 0, h, h, h, h, 0] when 2 then [0, 0, 0, h] else [] end) as py from blocks"


@query("placed", "blocks", "nested", sql=f"select w.insert_id, cast(w.depth as bigint) as depth, w.block, cast(count(*) as bigint) as points, cast(sum(w.a * p.px + w.b * p.py + w.tx) as double) as x, cast(sum(w.c * p.px + w.d * p.py + w.ty) as double) as y from block_ways w join ({_POINTS}) p on p.block = w.block group by 1, 2, 3")
def block_expand(placed: DataFrame, blocks: DataFrame, nested: DataFrame) -> DataFrame:
    """What each insert shows of each block that it reaches: how many points, and the sums of their coordinates."""
    from tesselar.operators.blocks import expand

    points = expand(*block_tables(placed, blocks, nested)).withColumn("p", F.explode("vertices"))
    return points.groupBy("insert_id", F.col("depth").cast("bigint").alias("depth"), "block").agg(F.count("*").alias("points"), F.sum("p.x").alias("x"), F.sum("p.y").alias("y"))


_PRINT = "select insert_id, min(case when kind = 0 then w * h end) as closed, min(case when kind = 1 then w * h end) as traced, min(case when kind = 2 then w * h end) as corner, max(abs(a * d - b * c)) as size from block_ways left join blocks using (block) group by 1"


@query("placed", "blocks", "nested", sql=f"select insert_id, case when closed is not null then 'closed' when traced is not null then 'traced' when corner is not null then 'hull' else 'placeholder' end as source, cast(coalesce(closed * size, traced * size, corner * size / 2, 160000) as double) as area from ({_PRINT}) p")
def column_footprints(placed: DataFrame, blocks: DataFrame, nested: DataFrame) -> DataFrame:
    """Inserts of the column layer with the footprint that their blocks give, or the placeholder."""
    from tesselar.operators.blocks import footprints

    return footprints(*block_tables(placed, blocks, nested)).select("insert_id", "source", F.round("area", 1).alias("area"))


@query("seeds", sql="select cast(drawing_id as varchar) as drawing, cast(seed_id as varchar) as id, cast(x as double) as x, cast(y as double) as y from seeds")
def read_seeds(seeds: DataFrame) -> DataFrame:
    s = F.struct(F.col("seed_id").cast("string").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    texts = seeds.groupBy("drawing_id").agg(F.collect_list(s).alias("seeds"))
    one = F.struct(F.col("drawing_id").cast("string").alias("drawing"), "seeds")
    text = F.when(F.col("drawing_id") % 2 == 0, F.to_json(one)).otherwise(F.to_json(F.struct(F.array(one).alias("drawings"))))
    return D.read_seeds(texts.select(text.alias("text"))).select("drawing", "id", "x", "y")


@query("manifest_zones", sql="select label, cast(area_native as double) as area_sqm from manifest_zones")
def read_manifest(zones: DataFrame) -> DataFrame:
    z = F.struct("label", F.coalesce(F.col("area_native").cast("string"), F.lit("n/a")).alias("area_sqm"))
    text = zones.groupBy(F.lit("P").alias("project")).agg(F.collect_list(z).alias("zones")).select(F.to_json(F.struct("project", "zones")).alias("text"))
    return D.read_manifest(text).select("label", "area_sqm")


@query("segments", "layer_config", sql="select d.drawing_id, coalesce(m.manifest, 'default') as manifest from (select distinct drawing_id from segments) d left join (select drawing_id, min(layer) as manifest from layer_config group by 1) m on m.drawing_id = d.drawing_id")
def manifest_match(segments: DataFrame, config: DataFrame) -> DataFrame:
    """Manifests name a drawing by its base name in any case; a default where none does."""
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    own = segments.select("drawing_id").distinct().withColumn("name", name(F.concat(F.lit("in/Plan-"), F.col("drawing_id").cast("string"))))
    known = config.groupBy(name(F.concat(F.lit("PLAN-"), F.col("drawing_id").cast("string"))).alias("name")).agg(F.min("layer").alias("manifest"))
    return own.join(known, "name", "left").select("drawing_id", F.coalesce("manifest", F.lit("default")).alias("manifest"))


NAMED = "select s.drawing_id as seed_drawing, d.drawing_id, cast(s.n as bigint) as n from (select drawing_id, count(*) as n from seeds group by 1) s join (select distinct drawing_id from segments) d on 'plan-' || d.drawing_id || '.dxf' like '%plan-' || s.drawing_id || '%'"


@query("segments", "seeds", sql=NAMED)
def drawing_name_match(segments: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds by drawing name: equal, without the suffix, a beginning, or any part of it (so plan-1 fits plan-12 too)."""
    name = lambda text, suffix: F.concat(F.lit(text), F.col("drawing_id").cast("string"), F.lit(suffix))
    drawings = segments.select("drawing_id").distinct().withColumn("drawing", name("Plan-", ".DXF"))
    asked = seeds.groupBy("drawing_id").agg(F.count("*").alias("n")).select(F.col("drawing_id").alias("seed_drawing_id"), name("plan-", "").alias("seed_drawing"), "n")
    both = D.match_drawings(asked, drawings)
    return both.select(F.col("seed_drawing_id").alias("seed_drawing"), "drawing_id", "n")


def snapshots(records: DataFrame) -> DataFrame:
    p = F.struct("face_id", "status", "geometry_role")
    by = records.groupBy("drawing_id").agg(F.array_sort(F.collect_list(p)).alias("polygons"))
    version = F.when(F.col("drawing_id") % 7 == 3, 4).otherwise(3)
    return by.select(F.to_json(F.struct(F.col("drawing_id").cast("string").alias("id"), F.lit(D.FORMAT).alias("format"), version.alias("version"), "polygons")).alias("text"))


@query("records", sql="select drawing_id, face_id, coalesce(status, 'active') as status, coalesce(geometry_role, 'partition') as geometry_role from records where drawing_id % 7 <> 3")
def read_workspace(records: DataFrame) -> DataFrame:
    """Snapshots written as JSON and read back; those of a later version are quarantined."""
    good, _ = D.read_workspace(snapshots(records))
    return good.select(F.col("id").cast("bigint").alias("drawing_id"), F.explode("polygons").alias("p")).select("drawing_id", "p.face_id", "p.status", "p.geometry_role")


@query("records", sql="select distinct cast(drawing_id as varchar) as id, 'version' as reason from records where drawing_id % 7 = 3", name="workspace_quarantine")
def workspace_quarantine(records: DataFrame) -> DataFrame:
    return D.read_workspace(snapshots(records))[1]


LIVE = "coalesce(status, 'active') <> 'deleted'"
SAVED = f"select drawing_id, 1 as version, cast(count(*) filter (where {LIVE}) as bigint) as polygons from records group by 1 union all select drawing_id, 2, cast(count(*) filter (where {LIVE} and source <> 'manual') as bigint) from records group by 1"


@query("records", sql=SAVED, name="version_save")
def version_save(records: DataFrame) -> DataFrame:
    """Two saves by drawing, the second without manual polygons, and all versions read back."""
    return versions(records).select("drawing_id", "version", "polygons")


def versions(records: DataFrame) -> DataFrame:
    from tesselar.operators.state import Steps

    spark = records.sparkSession
    log = S.Log(spark, f"{Steps(spark).path}/versions")
    live = lambda df: df.groupBy(F.col("drawing_id").alias("project")).agg(F.count_if(F.coalesce("status", F.lit("active")) != "deleted").alias("polygons"))
    first = live(records)
    log.save(first)
    log.save(live(records.select("drawing_id", F.when(F.col("source") != "manual", F.coalesce("status", F.lit("active"))).otherwise("deleted").alias("status"))))
    return log.versions(first.schema, "project").withColumnRenamed("project", "drawing_id")


@query("records", sql=f"select drawing_id, version, polygons from ({SAVED}) v where version = 2")
def version_load(records: DataFrame) -> DataFrame:
    """The latest saved version of each drawing."""
    last = F.max_by(F.struct("version", "polygons"), "version")
    return versions(records).groupBy("drawing_id").agg(last.alias("l")).select("drawing_id", "l.version", "l.polygons")


@query("records", sql=f"select drawing_id, string_agg(version || ':' || polygons, ',' order by version) as versions from ({SAVED}) v group by 1")
def project_list(records: DataFrame) -> DataFrame:
    """Projects with their versions."""
    by = versions(records).groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("version", "polygons"))).alias("v"))
    text = F.transform("v", lambda x: F.concat(x["version"].cast("string"), F.lit(":"), x["polygons"].cast("string")))
    return by.select("drawing_id", F.array_join(text, ",").alias("versions"))


@query("records", sql="select drawing_id as session_id, face_id, status, zone from records")
def workspace_save(records: DataFrame) -> DataFrame:
    """Snapshots written by session, then written again (each session replaced as a whole), and read back."""
    from tesselar.operators.state import Steps

    log = S.Log(records.sparkSession, f"{Steps(records.sparkSession).path}/workspaces")
    rows = records.select(F.col("drawing_id").alias("session_id"), "face_id", "status", "zone")
    log.save(rows.withColumn("status", F.lit("stale")))
    log.save(rows)
    return log.latest(rows.schema, "session_id")


@query("segments", sql="select distinct 'plan-' || drawing_id || '.dxf' as name from segments")
def drawing_catalog(segments: DataFrame) -> DataFrame:
    """Drawings written as tag files and listed without reading them."""
    found = T.drawing_catalog(segments.sparkSession, written(segments), "*.txt").where("length > 0")
    return found.select(F.concat(F.lit("plan-"), F.regexp_extract("path", r"drawing=(\d+)/", 1), F.lit(".dxf")).alias("name")).distinct()


@query("records", sql="select drawing_id, 'data' as category, count(*) as lines, sha256(string_agg(cast(face_id as varchar) || chr(10), '' order by face_id)) as sha256 from records group by 1")
def delivery_manifest(records: DataFrame) -> DataFrame:
    """One file of ids by drawing, written, read back as bytes, and digested."""
    from tesselar.operators.state import Steps

    spark = records.sparkSession
    path = f"{Steps(spark).path}/delivery"
    ids = records.select("drawing_id", F.col("face_id").cast("string").alias("value"), "face_id").repartition("drawing_id").sortWithinPartitions("drawing_id", "face_id")
    ids.select("drawing_id", "value").write.partitionBy("drawing_id").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    digest = S.delivery_manifest(files.withColumn("path", F.regexp_replace("path", r"\.txt$", ".json")))
    lines = F.size(F.split(files["content"].cast("string"), "\n")) - 1
    counted = files.select(F.regexp_replace("path", r"\.txt$", ".json").alias("path"), lines.cast("bigint").alias("lines"))
    return digest.join(counted, "path").select(F.regexp_extract("path", r"drawing_id=(\d+)", 1).cast("bigint").alias("drawing_id"), "category", "lines", "sha256")


REPORT = "select drawing_id, cast(face_id as varchar) as region, cast((x1 - x0) * (y1 - y0) as bigint) as area, round((x0 + x1) / 2000.0, 4) as cx from faces union all select drawing_id, 'TOTAL', cast(sum((x1 - x0) * (y1 - y0)) as bigint), null from faces group by 1"


@query("faces", sql=REPORT)
def regions_report(faces: DataFrame) -> DataFrame:
    """Regions with centres in metres, and a TOTAL row by drawing."""
    own = faces.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    rows = own.groupingSets([["drawing_id", "face_id"], ["drawing_id"]], "drawing_id", "face_id").agg(F.sum("area").alias("area"), F.first(F.round((F.col("x0") + F.col("x1")) / 2000, 4)).alias("cx"))
    total = F.col("face_id").isNull()
    return rows.select("drawing_id", F.when(total, "TOTAL").otherwise(F.col("face_id").cast("string")).alias("region"), "area", F.when(~total, F.col("cx")).alias("cx"))


@query("faces", "bays", sql="select 'INT-' || bay_id as label, cast(count(*) as bigint) as faces, cast(sum(area) as bigint) as area from assigned group by bay_id union all select 'TOTAL', cast(count(*) as bigint), cast(sum(area) as bigint) from assigned")
def zone_schedule(faces: DataFrame, bays: DataFrame) -> DataFrame:
    from tesselar.operators.zones import assign_faces

    z = assign_faces(faces, bays).rollup("bay_id").agg(F.count("*").alias("faces"), F.sum("area").alias("area"))
    return z.select(F.coalesce(F.concat(F.lit("INT-"), F.col("bay_id").cast("string")), F.lit("TOTAL")).alias("label"), "faces", "area")


@query("records", sql=f"select face_id, zone, source, area_native from records where {PARTITION}")
def polygon_csv_export(records: DataFrame) -> DataFrame:
    return records.where(R.is_partition(F.col("status"), F.col("scope_excluded"), F.col("geometry_role"))).select("face_id", "zone", "source", "area_native")


@query("records", sql=f"select zone, cast(count(*) as bigint) as polygons, cast(sum(area_native) as bigint) as area from records where {PARTITION} group by 1")
def polygon_schedule_export(records: DataFrame) -> DataFrame:
    return polygon_csv_export(records).groupBy("zone").agg(F.count("*").alias("polygons"), F.sum("area_native").alias("area"))


@query("records", sql=f"select face_id, json_object('face_id', face_id, 'zone', zone) as json from records where {PARTITION}")
def polygon_json_export(records: DataFrame) -> DataFrame:
    return polygon_csv_export(records).select("face_id", F.to_json(F.struct("face_id", "zone")).alias("json"))


@query("segments", sql="select drawing_id, status, cast(count(*) as bigint) as gaps, round(max(distance), 3) as widest, cast(count(*) filter (where distance > 500) as bigint) as above from gaps group by 1, 2")
def gap_report_export(segments: DataFrame) -> DataFrame:
    """The gap report written as Parquet and read back: gaps by drawing and status, the widest, and how many are above the threshold."""
    from tesselar.operators.gaps import gaps
    from tesselar.operators.state import Steps

    by = gaps(segments).groupBy("drawing_id", "status").agg(F.count("*").alias("gaps"), F.round(F.max("distance"), 3).alias("widest"), F.count_if(F.coalesce(F.col("distance") > 500, F.lit(False))).alias("above"))
    return Steps(segments.sparkSession).cut(by)


@query("records", sql="select drawing_id, json_object('drawing', drawing_id, 'records', cast(count(*) as bigint), 'config', json_object('unit', 'mm', 'threshold', 500)) as log from records group by drawing_id")
def coverage_log(records: DataFrame) -> DataFrame:
    """The run's log as JSON with its settings, written as text and read back."""
    from tesselar.operators.state import Steps

    spark = records.sparkSession
    by = records.groupBy(F.col("drawing_id").alias("drawing")).agg(F.count("*").alias("records"))
    config = F.struct(F.lit("mm").alias("unit"), F.lit(500).alias("threshold"))
    path = f"{Steps(spark).path}/log"
    by.select(F.to_json(F.struct("drawing", "records", config.alias("config"))).alias("value")).write.text(path)
    return spark.read.text(path).select(F.get_json_object("value", "$.drawing").cast("bigint").alias("drawing_id"), F.col("value").alias("log"))
