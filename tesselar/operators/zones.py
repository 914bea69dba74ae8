"""Faces to bays, and zones from assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.operators.cells import renamed
from tesselar.operators.graph import components
from tesselar.operators.state import Steps, shared


def assign_faces(faces: DataFrame, bays: DataFrame) -> DataFrame:
    """Each face to the bay that it overlaps most, ties to the smaller bay: drawing_id, face_id, bay_id, area."""
    from tesselar.plans.joins import overlapping

    best = F.max(F.struct("area", (-F.col("bay_id")).alias("b"), "bay_id"))
    return overlapping(faces, bays).groupBy("drawing_id", "face_id").agg(best.alias("m")).select("drawing_id", "face_id", "m.bay_id", "m.area")


def assign_with_nearest(faces: DataFrame, bays: DataFrame, sliver: int) -> DataFrame:
    """Faces that are no slivers: by overlap, else to the nearest bay, with the method's name."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    kept = faces.where(area >= sliver)
    got = assign_faces(kept, bays)
    centres = bays.groupBy(F.lit(0).alias("k")).agg(F.collect_list(F.struct("bay_id", (F.col("x0") + F.col("x1")).alias("x"), (F.col("y0") + F.col("y1")).alias("y"))).alias("all"))
    lone = kept.join(got.select("face_id"), "face_id", "left_anti").withColumn("k", F.lit(0)).join(centres, "k")
    far = F.transform("all", lambda b: F.struct((F.pow(F.col("x0") + F.col("x1") - b["x"], F.lit(2)) + F.pow(F.col("y0") + F.col("y1") - b["y"], F.lit(2))).alias("d"), b["bay_id"].alias("bay_id")))
    near = lone.select("drawing_id", "face_id", F.array_min(far)["bay_id"].alias("bay_id"), F.lit(0).cast("bigint").alias("area"), F.lit("max_overlap+nearest").alias("method"))
    return got.withColumn("method", F.lit("max_overlap")).unionByName(near)


def clipped(boxes: DataFrame, width: float) -> DataFrame:
    """Boxes cut at the borders of square cells (cx, cy)."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / width).cast("bigint"), (F.ceil(F.col(b) / width) - 1).cast("bigint"))
    out = boxes.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    low = {f"{c}0": F.greatest(f"{c}0", F.col(f"c{c}") * F.lit(width)) for c in "xy"}
    high = {f"{c}1": F.least(f"{c}1", (F.col(f"c{c}") + 1) * F.lit(width)) for c in "xy"}
    return out.withColumns(low | high)


def union_area(boxes: DataFrame, keys: list[str], side: int = 4096, few: int = 32) -> DataFrame:
    """Area of the union of each key's boxes.

    Boxes are clipped to square cells. A cell that one of its boxes fills counts as a whole, whatever else is in it; one with few boxes is cut into strips;
    any other is split into four, and so on. Where boxes are many, small cells are soon filled, so rows stay in proportion to the boxes however dense
    a key is, and no cell's boxes are compared with all of a key's.
    """
    steps = Steps(boxes.sparkSession)
    at = [*keys, "cx", "cy"]
    area = None

    left, width = boxes.select(*keys, "x0", "y0", "x1", "y1").where("x0 < x1 and y0 < y1"), side
    while True:
        rows = steps.cut(clipped(left, width).distinct())
        full = (F.col("x1") - F.col("x0") == width) & (F.col("y1") - F.col("y0") == width)
        state = rows.groupBy(*at).agg(F.bool_or(full).alias("full"), F.count("*").alias("n"))
        whole = state.where("full").groupBy(*keys).agg((F.count("*") * F.lit(width) * F.lit(width)).alias("area"))
        last = width / 2 < 1  # whole numbers are full in unit cells; others go to strips
        some = state.where(~F.col("full") & ((F.col("n") <= few) | F.lit(last)))
        now = whole.unionByName(_strips(rows.join(some.select(*at), at), at).groupBy(*keys).agg(F.sum("area").alias("area")))
        area = now if area is None else area.unionByName(now)
        if last:
            break
        left, n = steps.cut_and_count(rows.join(state.where((~F.col("full")) & (F.col("n") > few)).select(*at), at).select(*keys, "x0", "y0", "x1", "y1"), F.lit(True))
        if not n:
            break
        width //= 2
    return area.groupBy(*keys).agg(F.sum("area").alias("area"))


def _strips(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The same for keys with few boxes: strips between neighbouring x, in each the lengths that intervals add to those before."""
    order = Window.partitionBy(*keys).orderBy("xa")
    edges = boxes.select(*keys, F.explode(F.array("x0", "x1")).alias("xa")).distinct()
    strips = edges.withColumn("xb", F.lead("xa").over(order)).where("xb is not null")
    inside = boxes.join(strips, keys).where("x0 <= xa and x1 >= xb")
    before = Window.partitionBy(*keys, "xa").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    adds = F.greatest(F.lit(0), F.col("y1") - F.greatest("y0", F.coalesce(F.max("y1").over(before), F.col("y0"))))
    return inside.select(*keys, ((F.col("xb") - F.col("xa")) * adds).alias("a")).groupBy(*keys).agg(F.sum("a").alias("area"))


def linked_boxes(boxes: DataFrame, keys: list[str], steps: Steps, side: int = 8192, few: int = 8) -> DataFrame:
    """Pairs (a, b) of overlapping boxes (id, whole numbers) of a key that connect all those that overlap, far fewer than all such pairs.

    Boxes are clipped to square cells. In a cell that one box fills, it overlaps every other: these are tied to it alone. A cell with few boxes is compared box by box; any
    other is split into four. Boxes that look alike in a cell are one from there on.
    """
    at = [*keys, "cx", "cy"]
    box = ["x0", "y0", "x1", "y1"]
    left, width, out = boxes.select(*keys, "id", *box).where("x0 < x1 and y0 < y1"), side, None
    while True:
        rows = steps.cut(clipped(left, width))
        one = rows.groupBy(*at, *box).agg(F.min("id").alias("one"))
        ties = rows.join(one, [*at, *box]).where("id <> one").select(F.col("one").alias("a"), F.col("id").alias("b")).distinct()
        one = steps.cut(one.withColumnRenamed("one", "id"))
        full = (F.col("x1") - F.col("x0") == width) & (F.col("y1") - F.col("y0") == width)
        state = one.groupBy(*at).agg(F.min(F.when(full, F.col("id"))).alias("hub"), F.count("*").alias("n"))
        known = steps.cut(one.join(state, at))
        hubs = known.where("hub is not null and hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        some = known.where(F.col("hub").isNull() & (F.col("n") <= few)).select(*at, "id", *box)
        both = renamed(some, "a", *at).join(renamed(some, "b", *at), at).where("aid < bid and ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1")
        now = steps.cut(ties.unionByName(hubs).unionByName(both.select(F.col("aid").alias("a"), F.col("bid").alias("b"))))
        out = now if out is None else out.unionByName(now)
        left, n = steps.cut_and_count(known.where(F.col("hub").isNull() & (F.col("n") > few)).select(*keys, "id", *box), F.lit(True))
        if not n:
            return out
        width //= 2


def zone_parts(boxes: DataFrame) -> DataFrame:
    """(drawing_id, bay_id, face_id, box) with part: boxes of a zone that overlap or share some of an edge are one part."""
    steps = Steps(boxes.sparkSession)
    rows = steps.cut(boxes)
    # boxes of whole numbers touch along an edge if they overlap when both are half a unit wider, or both half a unit higher
    grown = lambda c: rows.select("drawing_id", "bay_id", F.col("face_id").alias("id"), *((2 * F.col(f"{k}0") - int(k == c)).alias(f"{k}0") for k in "xy"), *((2 * F.col(f"{k}1") + int(k == c)).alias(f"{k}1") for k in "xy"))
    links = linked_boxes(grown("x"), ["drawing_id", "bay_id"], steps).unionByName(linked_boxes(grown("y"), ["drawing_id", "bay_id"], steps)).distinct()
    label = components(rows.select(F.col("face_id").alias("id")), links, steps)
    return rows.join(label.select(F.col("id").alias("face_id"), F.col("label").alias("part")), "face_id")


def zones(faces: DataFrame, bays: DataFrame, sliver: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """By drawing and bay: ids of its faces in order, their number and area, and the area of their union's largest part; and the boxes of
    these parts. Slivers are left out."""
    parts = shared(f"zone-parts-{sliver}", lambda f, b: _parts(f, b, sliver), faces, bays)
    each = shared(f"zone-areas-{sliver}", lambda p: union_area(p, ["drawing_id", "bay_id", "part"]), parts)
    best = each.groupBy("drawing_id", "bay_id").agg(F.max(F.struct("area", (-F.col("part")).alias("p"), "part")).alias("m")).select("drawing_id", "bay_id", "m.area", "m.part")
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    by = parts.groupBy("drawing_id", "bay_id").agg(F.array_sort(F.collect_list("face_id")).alias("face_ids"), F.count("*").alias("faces"), F.sum(size).alias("face_sum"))
    boxes = parts.join(best.select("drawing_id", "bay_id", "part"), ["drawing_id", "bay_id", "part"])
    return by.join(best.drop("part"), ["drawing_id", "bay_id"]), boxes


def _parts(faces: DataFrame, bays: DataFrame, sliver: int) -> DataFrame:
    kept = faces.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= sliver)
    got = assign_faces(kept, bays).select("face_id", "bay_id")
    return zone_parts(kept.join(got, "face_id").select("drawing_id", "bay_id", "face_id", "x0", "y0", "x1", "y1"))
