"""Rankings, sequences and grid steps as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import review as R
from tesselar.operators import gaps as P
from tesselar.operators import grid as G
from tesselar.operators import zones as Z
from tesselar.plans.filters import HINT
from tesselar.plans.registry import query

AREA = "(x1 - x0) * (y1 - y0)"


def _area():
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def _rank(keys: list[str], *order):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")


@query("faces", sql=f"select face_id, drawing_id, n, 'R ' || cast(n as varchar) as label from (select *, row_number() over (partition by drawing_id order by {AREA} desc, x0, y0, face_id) as n from faces) f")
def region_numbering(faces: DataFrame) -> DataFrame:
    n = _rank(["drawing_id"], _area().desc(), "x0", "y0", "face_id")
    return faces.withColumn("n", n).select("face_id", "drawing_id", "n", F.concat(F.lit("R "), F.col("n").cast("string")).alias("label"))


CLUSTER = "select drawing_id, angle_deg, cluster, cast(count(*) as bigint) as lines, sum(position_mm) as total, sum(position_mm) / cast(count(*) as double) as position from (select *, sum(case when step <= 500 then 0 else 1 end) over (partition by drawing_id, angle_deg order by position_mm, line_id rows unbounded preceding) as cluster from (select *, position_mm - lag(position_mm) over (partition by drawing_id, angle_deg order by position_mm, line_id) as step from grid_lines) s) c group by 1, 2, 3"


@query("grid_lines", sql=f"select drawing_id, cast(angle_deg as bigint) as angle_deg, cast(cluster as bigint) as cluster, lines, round(position, 3) as position from ({CLUSTER}) c")
def axis_cluster(lines: DataFrame) -> DataFrame:
    c = G.axis_clusters(lines)
    return c.select("drawing_id", F.col("angle_deg").cast("bigint").alias("angle_deg"), F.col("cluster").cast("bigint").alias("cluster"), "lines", F.round("position", 3).alias("position"))


@query("grid_lines", sql="select drawing_id, cast(case when angle_deg = 90 then 90 else 0 end as bigint) as family, cast(count(*) as bigint) as lines from grid_lines group by 1, 2")
def angle_family(lines: DataFrame) -> DataFrame:
    """Orthogonal lines fall to the nearer axis; 180 degrees folds to 0."""
    a = F.pmod(F.col("angle_deg"), F.lit(180))
    return lines.groupBy("drawing_id", F.when(a.between(45, 134), 90).otherwise(0).cast("bigint").alias("family")).agg(F.count("*").alias("lines"))


@query("grid_lines", sql="select drawing_id, cast(angle_deg as bigint) as angle_deg, row_number() over (partition by drawing_id order by n desc, angle_deg) as place from (select drawing_id, angle_deg, count(*) as n from grid_lines group by 1, 2) g")
def axis_rank(lines: DataFrame) -> DataFrame:
    by = lines.groupBy("drawing_id", F.col("angle_deg").cast("bigint").alias("angle_deg")).agg(F.count("*").alias("n"))
    return by.withColumn("place", _rank(["drawing_id"], F.col("n").desc(), "angle_deg")).where("place <= 2").drop("n")


@query("grid_lines", sql=f"select drawing_id, cast(angle_deg as bigint) as angle_deg, round(position, 3) as position from (select *, row_number() over (partition by drawing_id, angle_deg order by position) - 1 as r, count(*) over (partition by drawing_id, angle_deg) as n from ({CLUSTER}) c) p where exists (select 1 from range(0, 5) k(i) where round_even(i * (n - 1) / 4.0, 0) = r)")
def axis_select(lines: DataFrame) -> DataFrame:
    picked = G.axis_select(G.axis_clusters(lines), ["drawing_id", "angle_deg"], 4)
    return picked.select("drawing_id", F.col("angle_deg").cast("bigint").alias("angle_deg"), F.round("position", 3).alias("position"))


AXES = f"select drawing_id, cast(count(*) filter (where angle_deg = 90) as bigint) as nx, cast(count(*) filter (where angle_deg = 0) as bigint) as ny from ({CLUSTER}) c group by 1"


def target_sql(n: int) -> str:
    """columns, rows and mode of every drawing for n bays."""
    pairs = ", ".join(f"({a}, {n // a})" for a in range(1, n + 1) if n % a == 0)
    best = f"select *, row_number() over (partition by drawing_id order by round(least((a + 1.0) / nx, (b + 1.0) / ny), 9) desc, least(a, b), a) as r from ({AXES}) n, (values {pairs}) v(a, b) where a <= nx - 1 and b <= ny - 1"
    return f"select x.drawing_id, cast(coalesce(t.a, greatest(x.nx - 1, 0)) as bigint) as columns, cast(coalesce(t.b, greatest(x.ny - 1, 0)) as bigint) as rows, case when t.a is null then 'raw_unmatched_target' else 'target_{n}' end as mode from ({AXES}) x left join (select * from ({best}) b where r = 1) t on t.drawing_id = x.drawing_id"


def axis_counts(lines: DataFrame) -> DataFrame:
    of = lambda a: F.count_if(F.col("angle_deg") == a)
    return G.axis_clusters(lines).groupBy("drawing_id").agg(of(90).alias("nx"), of(0).alias("ny"))


@query("grid_lines", sql=target_sql(12))
def axis_target(lines: DataFrame) -> DataFrame:
    return G.axis_target(axis_counts(lines), 12).select("drawing_id", "columns", "rows", "mode")


CELLS = f"select drawing_id, angle_deg, round(position, 3) as lo, round(lead(position) over (partition by drawing_id, angle_deg order by position), 3) as hi, row_number() over (partition by drawing_id, angle_deg order by position) - 1 as k from ({CLUSTER}) c"


def _cells(lines: DataFrame) -> DataFrame:
    c = G.axis_clusters(lines).withColumn("position", F.round("position", 3))
    return G.bay_cells(c.where("angle_deg = 90").select("drawing_id", "position"), c.where("angle_deg = 0").select("drawing_id", "position"))


@query("grid_lines", sql=f"select x.drawing_id, x.lo as x0, x.hi as x1, y.lo as y0, y.hi as y1, cast(x.k as bigint) as col_no, cast(y.k as bigint) as row_no from ({CELLS}) x join ({CELLS}) y on x.drawing_id = y.drawing_id and x.angle_deg = 90 and y.angle_deg = 0 where x.hi is not null and y.hi is not null")
def bay_cells(lines: DataFrame) -> DataFrame:
    return _cells(lines).select("drawing_id", "x0", "x1", "y0", "y1", F.col("col_no").cast("bigint").alias("col_no"), F.col("row_no").cast("bigint").alias("row_no"))


@query("bays", sql="select bay_id, 'INT-' || cast(row_number() over (order by row_no, col_no, bay_id) as varchar) as label from bays")
def bay_labels(bays: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("row_no", "col_no", "bay_id"))  # one grid, a few bays
    return bays.select("bay_id", F.concat(F.lit("INT-"), n.cast("string")).alias("label"))


@query("faces", "bays", sql="select bay_id, area from (select b.bay_id, cast(coalesce(sum(a.area), 0) as bigint) as area, row_number() over (order by case when coalesce(sum(a.area), 0) = 0 then 1 else 0 end, coalesce(sum(a.area), 0) desc, b.bay_id) as r from bays b left join assigned a on a.bay_id = b.bay_id group by b.bay_id) t where r <= 20")
def trim_bays(faces: DataFrame, bays: DataFrame) -> DataFrame:
    by = bays.join(Z.assign_faces(faces, bays), "bay_id", "left").groupBy("bay_id").agg(F.coalesce(F.sum("area"), F.lit(0)).alias("area"))
    return G.trim_bays(by.withColumn("drawing_id", F.lit(0)), 20).select("bay_id", "area")


BYLAYER = "select drawing_id, layer, cast(count(*) as bigint) as n from entities where entity_type <> 'INSERT' group by 1, 2"


@query("entities", sql=f"select drawing_id, layer, n, row_number() over (partition by drawing_id order by n desc, layer) as place from ({BYLAYER}) l")
def layer_ranking(entities: DataFrame) -> DataFrame:
    by = entities.where(F.col("entity_type").isin(*R.SUPPORTED)).groupBy("drawing_id", "layer").agg(F.count("*").alias("n"))
    return by.withColumn("place", _rank(["drawing_id"], F.col("n").desc(), "layer"))


@query("entities", sql=f"select drawing_id, layer, n, row_number() over (partition by drawing_id order by n desc, layer) as place from ({BYLAYER}) l where n >= 4 and layer not like '%TEXT%' and layer not like '%NOTE%' and layer not like '%GRID%'")
def candidate_layers(entities: DataFrame) -> DataFrame:
    return candidates(entities)


def candidates(entities: DataFrame) -> DataFrame:
    by = entities.where(F.col("entity_type").isin(*R.SUPPORTED)).groupBy("drawing_id", "layer").agg(F.count("*").alias("n"))
    return by.where((F.col("n") >= 4) & ~R.annotation_layer(F.col("layer"))).withColumn("place", _rank(["drawing_id"], F.col("n").desc(), "layer"))


CONFIGURED = "select distinct l.drawing_id, l.layer from (" + BYLAYER + ") l join layer_config c on c.drawing_id = l.drawing_id and upper(c.layer) = upper(l.layer)"


@query("entities", "layer_config", sql=f"with own as ({CONFIGURED}) select drawing_id, layer, 'configured' as source from own union all select drawing_id, layer, 'auto_fallback' from ({BYLAYER}) l where n >= 4 and not {HINT} and drawing_id not in (select drawing_id from own) union all select distinct drawing_id, layer, 'configured' from layer_config c where drawing_id in (select drawing_id from entities) and drawing_id not in (select drawing_id from own) and drawing_id not in (select drawing_id from ({BYLAYER}) l where n >= 4 and not {HINT})")
def layer_resolve(entities: DataFrame, config: DataFrame) -> DataFrame:
    """By drawing the configured layers that have geometry, else the candidates, else the configured ones as they are."""
    by = entities.where(F.col("entity_type").isin(*R.SUPPORTED)).select("drawing_id", "layer").distinct()
    own = by.join(config.select("drawing_id", F.upper("layer").alias("up")).distinct(), (by["layer"] == F.col("up")) & (by["drawing_id"] == config["drawing_id"]), "left_semi").withColumn("source", F.lit("configured"))
    rest = candidates(entities).join(own.select("drawing_id").distinct(), "drawing_id", "left_anti").select("drawing_id", "layer", F.lit("auto_fallback").alias("source"))
    known = own.select("drawing_id").unionByName(rest.select("drawing_id")).distinct()
    bare = config.select("drawing_id", "layer").distinct().join(entities.select("drawing_id").distinct(), "drawing_id", "left_semi").join(known, "drawing_id", "left_anti").withColumn("source", F.lit("configured"))
    return own.unionByName(rest).unionByName(bare)


@query("entities", "layer_config", sql="select drawing_id, layer, cast(count(*) as bigint) as n from entities e where upper(layer) like '%GRID%' and not exists (select 1 from layer_config c where c.drawing_id = e.drawing_id and upper(c.layer) = upper(e.layer)) group by 1, 2")
def grid_layer_candidates(entities: DataFrame, config: DataFrame) -> DataFrame:
    """Layers with GRID in their name that the drawing's configuration does not name."""
    named = entities.where(F.upper("layer").contains("GRID")).withColumn("up", F.upper("layer"))
    known = config.select("drawing_id", F.upper("layer").alias("up")).distinct()
    return named.join(known, ["drawing_id", "up"], "left_anti").groupBy("drawing_id", "layer").agg(F.count("*").alias("n"))


RANKED = "select g.drawing_id, g.ax, g.ay, g.bx, g.by_, g.status, case g.status when 'within_threshold_unclosed' then 100 when 'above_threshold_close' then 80 when 'orphan_endpoint' then 60 else 40 end as priority, f.reason, exists (select 1 from faces f where f.drawing_id = g.drawing_id and g.ax + coalesce(g.bx, g.ax) between 2 * f.x0 and 2 * f.x1 and g.ay + coalesce(g.by_, g.ay) between 2 * f.y0 and 2 * f.y1) as recoverable from gaps g left join gap_failed f on f.drawing_id = g.drawing_id and f.ax = g.ax and f.ay = g.ay"


@query("segments", "faces", sql=f"select drawing_id, ax, ay, bx, by_ as \"by\", priority, recoverable, priority + case when recoverable then 20 else 0 end - case when reason = 'bearing_mismatch_suspected' then 5 else 0 end as confidence from ({RANKED}) r")
def suspected_gap_ranking(segments: DataFrame, faces: DataFrame) -> DataFrame:
    """Gaps by status; those whose middle lies in a face count as recoverable, and a bearing mismatch as less certain."""
    return ranked(segments, faces).select("drawing_id", "ax", "ay", "bx", "by", "priority", "recoverable", "confidence")


def ranked(segments: DataFrame, faces: DataFrame) -> DataFrame:
    from tesselar.operators.cells import points_in_boxes
    from tesselar.plans.joins import with_reasons

    every = with_reasons(P.gaps(segments))
    middle = {c: (F.col(f"a{c}") + F.coalesce(f"b{c}", f"a{c}")) / 2 for c in "xy"}
    hit = points_in_boxes(every.select("drawing_id", "ax", "ay", *(v.alias(k) for k, v in middle.items())), faces.select("drawing_id", "x0", "y0", "x1", "y1"), 4000).select("drawing_id", "ax", "ay").distinct().withColumn("hit", F.lit(True))
    out = every.join(hit, ["drawing_id", "ax", "ay"], "left").withColumn("recoverable", F.coalesce("hit", F.lit(False))).withColumn("priority", P.priority(F.col("status")))
    confidence = F.col("priority") + F.when(F.col("recoverable"), 20).otherwise(0) - F.when(F.col("reason") == P.BEARING, 5).otherwise(0)
    return out.withColumn("confidence", confidence)


@query("seeds", sql="select min(seed_id) as seed_id, drawing_id, x - x % 500 as kx, y - y % 500 as ky from seeds group by 2, 3, 4")
def point_dedupe(seeds: DataFrame) -> DataFrame:
    keyed = seeds.select("seed_id", "drawing_id", (F.col("x") - F.col("x") % 500).alias("kx"), (F.col("y") - F.col("y") % 500).alias("ky"))
    from tesselar.operators.endpoints import first_by

    return first_by(keyed, ["drawing_id", "kx", "ky"], F.col("seed_id"))


@query("faces", sql=f"select drawing_id, area from (select drawing_id, {AREA} as area, row_number() over (partition by drawing_id order by {AREA} desc, face_id) as r, count(*) over (partition by drawing_id) as n from faces) t where r = cast(floor(0.2 * n) as bigint) + 1")
def area_threshold(faces: DataFrame) -> DataFrame:
    w = Window.partitionBy("drawing_id")
    ranked = faces.select("drawing_id", _area().alias("area"), F.row_number().over(w.orderBy(_area().desc(), "face_id")).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("r") == F.floor(F.col("n") * 0.2) + 1).select("drawing_id", "area")


@query("faces", "bays", sql="select bay_id, n from (select bay_id, cast(count(*) as bigint) as n, row_number() over (order by count(*) desc, bay_id) as r from assigned group by 1) t where r <= 5")
def dense_zones(faces: DataFrame, bays: DataFrame) -> DataFrame:
    return Z.assign_faces(faces, bays).groupBy("bay_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "bay_id").limit(5)


@query("faces", sql=f"select drawing_id, face_id, place from (select *, row_number() over (partition by drawing_id order by {AREA} desc, face_id) as place from faces) t where place <= 10")
def top_regions(faces: DataFrame) -> DataFrame:
    return faces.withColumn("place", _rank(["drawing_id"], _area().desc(), "face_id")).where("place <= 10").select("drawing_id", "face_id", "place")


@query("bays", sql="select string_agg(cast(row_no as varchar) || ':' || cast(col_no as varchar) || '=INT-' || cast(bay_id as varchar), ',' order by cast(row_no as varchar) || ':' || cast(col_no as varchar)) as signature from bays")
def label_signature(bays: DataFrame) -> DataFrame:
    part = F.struct(F.concat_ws(":", F.col("row_no").cast("string"), F.col("col_no").cast("string")).alias("k"), F.col("bay_id").cast("string").alias("b"))
    rows = F.transform(F.array_sort(F.collect_list(part)), lambda p: F.concat(p["k"], F.lit("=INT-"), p["b"]))
    return bays.agg(F.array_join(rows, ",").alias("signature"))


@query("faces", sql=f"select f.face_id, f.drawing_id, row_number() over (partition by f.drawing_id order by {AREA} desc, f.face_id) as place from faces f where f.layer in (select distinct b from (select min(layer) as b from faces group by drawing_id union all select max(layer) from faces group by drawing_id) w)")
def closed_loops(faces: DataFrame) -> DataFrame:
    """Closed outlines on wall layers (the first and the last layer of any drawing), one by handle, the largest first."""
    by = faces.groupBy("drawing_id").agg(F.min("layer").alias("a"), F.max("layer").alias("b"))
    walls = by.select(F.explode(F.array("a", "b")).alias("layer")).distinct()
    return faces.join(walls, "layer", "left_semi").dropDuplicates(["face_id"]).select("face_id", "drawing_id", _rank(["drawing_id"], _area().desc(), "face_id").alias("place"))


@query("segments", sql="select drawing_id, ax, ay, bx, by_ as \"by\", round(distance, 3) as distance, al as alayer, bl as blayer, status from gaps")
def gap_pairing(segments: DataFrame) -> DataFrame:
    """Free ends paired up to 10,000, the nearest first; the rest are orphans."""
    return P.gaps(segments).select("drawing_id", "ax", "ay", "bx", "by", F.round("distance", 3).alias("distance"), "alayer", "blayer", "status")


@query("segments", sql="select drawing_id, ax, ay, bx, by_ as \"by\", cast(delta as double) as delta, reason from gap_failed")
def gap_failures(segments: DataFrame) -> DataFrame:
    """Why a gap within the threshold stays open: its bearings differ by more than 75 degrees, or its ends were paired otherwise."""
    return P.failures(P.gaps(segments)).select("drawing_id", "ax", "ay", "bx", "by", "delta", "reason")
