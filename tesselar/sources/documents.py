"""Seeds, manifests and workspaces from JSON text: one schema, several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = "array<struct<id:string,x:double,y:double,label_hint:string>>"
VERSION, FORMAT = 3, "workspace"


def read_seeds(texts: DataFrame) -> DataFrame:
    """Column ``text``: a list of seeds, {seeds: [...]}, or {drawings: [{drawing, seeds}]}; drawing may be null."""
    listed = F.from_json("text", SEED)
    shaped = F.from_json("text", f"struct<drawing:string,seeds:{SEED},drawings:array<struct<drawing:string,seeds:{SEED}>>>")
    one = F.array(F.struct(F.lit(None).cast("string").alias("drawing"), listed.alias("seeds")))
    whole = F.array(F.struct(shaped["drawing"].alias("drawing"), shaped["seeds"].alias("seeds")))
    groups = F.when(F.ltrim("text").startswith("["), one).when(shaped["drawings"].isNotNull(), shaped["drawings"]).otherwise(whole)
    return texts.select(F.explode(groups).alias("g")).select("g.drawing", F.explode("g.seeds").alias("s")).select("drawing", "s.*").where("x is not null and y is not null")


def read_manifest(texts: DataFrame) -> DataFrame:
    """project, label, area_sqm, volume_cum: blank labels go, numbers that are none become null."""
    m = F.from_json("text", "struct<project:string,zones:array<struct<label:string,area_sqm:string,volume_cum:string>>>")
    rows = texts.select(m.alias("m")).select("m.project", F.explode("m.zones").alias("z")).where("trim(z.label) <> ''")
    return rows.select("project", F.trim("z.label").alias("label"), F.col("z.area_sqm").try_cast("double").alias("area_sqm"), F.col("z.volume_cum").try_cast("double").alias("volume_cum"))


def read_workspace(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good snapshots (id, version, polygons) with defaults filled in, and quarantined ones (id, reason)."""
    schema = "struct<id:string,format:string,version:int,polygons:array<struct<face_id:bigint,status:string,geometry_role:string>>>"
    rows = texts.select(F.from_json("text", schema).alias("w")).select("w.*")
    reason = F.when(F.coalesce("format", F.lit("")) != FORMAT, "format").when(F.col("version").isNull() | (F.col("version") > VERSION), "version")
    rows = rows.withColumn("reason", reason)
    filled = F.transform(F.coalesce("polygons", F.array().cast("array<struct<face_id:bigint,status:string,geometry_role:string>>")), lambda p: F.struct(p["face_id"].alias("face_id"), F.coalesce(p["status"], F.lit("active")).alias("status"), F.coalesce(p["geometry_role"], F.lit("partition")).alias("geometry_role")))
    return rows.where("reason is null").select("id", "version", filled.alias("polygons")), rows.where("reason is not null").select("id", "reason")


def match_drawings(seeds: DataFrame, drawings: DataFrame) -> DataFrame:
    """Rows of seeds (seed_drawing) and drawings (drawing) whose names match: the seed's is equal to the drawing's, in any case, or part of it.

    Distinct parts of drawing names meet seed names by equality, so no pair of names is formed that does not match. A null name
    matches every drawing; these seeds, few as they are, are given all names as one list.
    """
    names = drawings.select("drawing").distinct().withColumn("low", F.lower(F.trim("drawing")))
    start = F.explode(F.sequence(F.lit(1), F.length("low")))
    parts = names.where("low <> ''").withColumn("s", start).withColumn("n", F.explode(F.sequence(F.lit(1), F.length("low") - F.col("s") + 1)))
    parts = parts.select("drawing", F.expr("substring(low, s, n)").alias("part")).distinct()
    asked = seeds.select("seed_drawing").distinct().withColumn("part", F.lower(F.trim("seed_drawing")))
    pairs = asked.where("part is not null").join(parts, "part").select("seed_drawing", "drawing")
    named = seeds.join(pairs, "seed_drawing").join(drawings, "drawing")
    every = drawings.groupBy(F.lit(0).alias("k")).agg(F.collect_set("drawing").alias("all"))
    free = seeds.where("seed_drawing is null").withColumn("k", F.lit(0)).join(every, "k").withColumn("drawing", F.explode("all")).drop("k", "all").join(drawings, "drawing")
    return named.select(*free.columns).unionByName(free)
