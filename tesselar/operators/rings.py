"""Repair of rings that cross, touch or repeat themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.operators import overlay as O
from tesselar.operators import topology as T
from tesselar.operators.graph import components
from tesselar.operators.state import Steps

#: How far beside an edge (drawing units) a face is asked whether it is inside: twice the grid of the noding.
BESIDE = 2.0 / T.SCALE


def repaired(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, area and parts of every ring (id, ring) that encloses anything, and the edges (id, ux, uy, vx, vy) of the part that is kept.

    Each ring is noded with itself, as a drawing of its own. Of the faces that it cuts out, those are inside from which a ray crosses the ring an odd number of times;
    faces inside that share an edge (as along a spike into the ring) are one part, and the part of the largest area is kept. Rings of fewer than three points, or
    on one line, have no part. All rings are repaired at once.
    """
    steps = Steps(rings.sparkSession)
    sides = steps.cut(O.ring_edges(rings.select(F.col("id").alias("drawing_id"), "ring"), "drawing_id"))
    segs = sides.select("drawing_id", F.col("ux").alias("x1"), F.col("uy").alias("y1"), F.col("vx").alias("x2"), F.col("vy").alias("y2"))
    found, outlines = T.polygonize(T.node_edges(segs))
    found, outlines = steps.cut(found), steps.cut(outlines)
    edges = outlines.where("not hole").select("drawing_id", "face", *((F.col(c) / float(T.SCALE)).alias(c) for c in T.EDGE[1:]))
    length = F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))
    longest = edges.groupBy("drawing_id", "face").agg(F.max(F.struct(length.alias("l"), "ux", "uy", "vx", "vy")).alias("e")).select("drawing_id", F.col("face").alias("asked"), "e.*")
    # a face lies on the left of its edges
    points = longest.select("drawing_id", "asked", ((F.col("ux") + F.col("vx")) / 2 - BESIDE * (F.col("vy") - F.col("uy")) / F.col("l")).alias("x"), ((F.col("uy") + F.col("vy")) / 2 + BESIDE * (F.col("vx") - F.col("ux")) / F.col("l")).alias("y"))
    whole = sides.withColumn("face", F.lit(0))
    box = whole.groupBy("drawing_id", "face").agg(*(f(c).alias(n) for f, c, n in ((F.min, "ux", "x0"), (F.min, "uy", "y0"), (F.max, "ux", "x1"), (F.max, "uy", "y1"))))
    inside = O.crossings(points, box, whole, ["asked"], 4000.0).where("k % 2 = 1").select("drawing_id", F.col("asked").alias("face"))
    kept = steps.cut(found.join(inside, ["drawing_id", "face"]).select("drawing_id", "face", "area"))
    own = outlines.join(kept.select("drawing_id", "face"), ["drawing_id", "face"])
    low = F.least(F.struct("ux", "uy"), F.struct(F.col("vx").alias("ux"), F.col("vy").alias("uy")))
    high = F.greatest(F.struct("ux", "uy"), F.struct(F.col("vx").alias("ux"), F.col("vy").alias("uy")))
    both = own.groupBy("drawing_id", low.alias("u"), high.alias("v")).agg(F.min("face").alias("a"), F.max("face").alias("b")).where("a <> b")
    name = lambda c: F.struct("drawing_id", F.col(c).alias("face"))
    label = components(kept.select(name("face").alias("id")), both.select(name("a").alias("a"), name("b").alias("b")), steps)
    part = steps.cut(kept.join(label.select("id.drawing_id", "id.face", F.col("label.face").alias("part")), ["drawing_id", "face"]))
    areas = part.groupBy("drawing_id", "part").agg(F.sum("area").alias("area"))
    best = areas.groupBy("drawing_id").agg(F.max(F.struct("area", (-F.col("part")).alias("k"), "part")).alias("m"), F.count("*").alias("parts"))
    best = steps.cut(best.select("drawing_id", "m.area", "m.part", "parts"))
    largest = part.join(best.select("drawing_id", "part"), ["drawing_id", "part"], "left_semi")
    around = T.dissolve_edges(outlines, largest.select("drawing_id", "face", F.col("part").alias("grp")))
    # the direction that the part's own half-edge has
    directed = own.join(largest.select("drawing_id", "face"), ["drawing_id", "face"], "left_semi").withColumns({"a": low, "b": high})
    border = around.select("drawing_id", F.struct("ux", "uy").alias("a"), F.struct(F.col("vx").alias("ux"), F.col("vy").alias("uy")).alias("b"))
    rows = directed.join(border, ["drawing_id", "a", "b"], "left_semi").select(F.col("drawing_id").alias("id"), *((F.col(c) / float(T.SCALE)).alias(c) for c in T.EDGE[1:]))
    return best.select(F.col("drawing_id").alias("id"), "area", "parts"), rows
