"""Blocks: inserts expanded through blocks within blocks, and the footprint of each insert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.operators import topology as T
from tesselar.operators.state import Steps


def _matrix(scale: Column, angle: Column) -> dict[str, Column]:
    """A turn and a scale as a matrix (a, b; c, d); right angles without rounding."""
    quarter = F.pmod(angle, F.lit(360)) / 90
    exact = F.pmod(angle, F.lit(90)) == 0
    cos = F.when(exact, F.when(quarter == 0, 1.0).when(quarter == 2, -1.0).otherwise(0.0)).otherwise(F.cos(F.radians(angle)))
    sin = F.when(exact, F.when(quarter == 1, 1.0).when(quarter == 3, -1.0).otherwise(0.0)).otherwise(F.sin(F.radians(angle)))
    return {"a": scale * cos, "b": -scale * sin, "c": scale * sin, "d": scale * cos}


def expand(inserts: DataFrame, entities: DataFrame, nested: DataFrame) -> DataFrame:
    """insert_id, depth, block, entity, closed, vertices: all entities that an insert shows, at their places.

    ``inserts`` (insert_id, block, x, y, scale, angle) stand in drawings, ``nested`` (block, child, x, y, scale, angle) in blocks; ``entities`` (block, entity, closed,
    vertices) are relative to their block's base point. A round of joins goes one level down with the placements composed so far. A block that would
    hold itself, at any level, is not entered again.
    """
    steps = Steps(inserts.sparkSession)
    num = lambda c: F.col(c).cast("double")
    own = _matrix(num("scale"), num("angle"))
    level = inserts.select("insert_id", "block", F.lit(0).alias("depth"), *(v.alias(k) for k, v in own.items()), num("x").alias("tx"), num("y").alias("ty"), F.array("block").alias("way"))
    inner = nested.where("child is not null").select("block", "child", *(v.alias(f"n{k}") for k, v in own.items()), num("x").alias("nx"), num("y").alias("ny"))
    inner = steps.cut(inner)
    out = None
    level, n = steps.cut_and_count(level, F.lit(True))
    while n or out is None:
        at = lambda p: F.struct((F.col("a") * p["x"] + F.col("b") * p["y"] + F.col("tx")).alias("x"), (F.col("c") * p["x"] + F.col("d") * p["y"] + F.col("ty")).alias("y"))
        shown = level.join(entities, "block").select("insert_id", "depth", "block", "entity", "closed", F.transform("vertices", at).alias("vertices"))
        out = shown if out is None else out.unionByName(shown)
        down = level.join(inner, "block").where(~F.array_contains("way", F.col("child")))
        product = {"a": "a * na + b * nc", "b": "a * nb + b * nd", "c": "c * na + d * nc", "d": "c * nb + d * nd", "tx": "a * nx + b * ny + tx", "ty": "c * nx + d * ny + ty"}
        level, n = steps.cut_and_count(down.select("insert_id", F.col("child").alias("block"), (F.col("depth") + 1).alias("depth"), *(F.expr(e).alias(k) for k, e in product.items()), F.concat("way", F.array("child")).alias("way")), F.lit(True))
    return out


def footprints(inserts: DataFrame, entities: DataFrame, nested: DataFrame, side: float = 400.0) -> DataFrame:
    """insert_id (a whole number), source, area, ring of every insert.

    The smallest closed outline that it shows; else the smallest face that its lines enclose, traced with the insert as the key; else the hull of its lines,
    if that has an area; else a square of ``side`` around its point.
    """
    steps = Steps(inserts.sparkSession)
    shown = steps.cut(expand(inserts, entities, nested))
    ring = F.col("vertices")
    closed = shown.where(F.col("closed") & (F.size("vertices") >= 3)).select("insert_id", G.ring_area(ring).alias("area"), ring.alias("ring")).where("area > 0")
    best = lambda df: df.groupBy("insert_id").agg(F.min(F.struct("area", "ring")).alias("m")).select("insert_id", "m.area", "m.ring")
    outlines = steps.cut(best(closed))
    lines = shown.where(~F.col("closed") & (F.size("vertices") >= 2)).join(outlines.select("insert_id"), "insert_id", "left_anti")
    sides = F.arrays_zip(F.slice("vertices", 1, F.size("vertices") - 1).alias("u"), F.slice("vertices", 2, F.size("vertices") - 1).alias("v"))
    segs = lines.select(F.col("insert_id").alias("drawing_id"), F.explode(sides).alias("s")).select("drawing_id", F.col("s.u.x").alias("x1"), F.col("s.u.y").alias("y1"), F.col("s.v.x").alias("x2"), F.col("s.v.y").alias("y2"))
    segs = steps.cut(segs)
    faces, around = T.polygonize(T.node_edges(segs))
    chosen = steps.cut(faces.groupBy("drawing_id").agg(F.min(F.struct("area", "face")).alias("m")).select("drawing_id", "m.face", "m.area"))
    rings = T.face_rings(around.join(chosen.select("drawing_id", "face"), ["drawing_id", "face"], "left_semi"))
    traced = chosen.join(rings, ["drawing_id", "face"]).select(F.col("drawing_id").alias("insert_id"), "area", "ring")
    ends = segs.select("drawing_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    hull = T.convex_hulls(ends.join(chosen.select("drawing_id"), "drawing_id", "left_anti").select("drawing_id", "p.x", "p.y")).where(F.size("ring") > 2)
    hull = hull.select(F.col("drawing_id").alias("insert_id"), G.ring_area(F.col("ring")).alias("area"), "ring").where("area > 0")
    named = lambda df, source: df.select("insert_id", F.lit(source).alias("source"), F.col("area").cast("double").alias("area"), "ring")
    found = steps.cut(named(outlines, "closed").unionByName(named(traced, "traced")).unionByName(named(hull, "hull")))
    square = G.placeholder_footprint(F.col("x").cast("double"), F.col("y").cast("double"), side)
    rest = inserts.join(found.select("insert_id"), "insert_id", "left_anti").select("insert_id", F.lit("placeholder").alias("source"), F.lit(side * side).alias("area"), square.alias("ring"))
    return found.unionByName(rest)
