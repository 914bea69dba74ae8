"""Segment ends, their degree, bearings and layers, and candidates for bridges between free ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.functions.review import tier2_layer_pair
from tesselar.operators.cells import near_points


def ends(segments: DataFrame) -> DataFrame:
    """Two rows for each segment: the end, and the bearing (degrees) at which the segment arrives there."""
    out = lambda a, b: F.struct(F.col(f"x{a}").alias("x"), F.col(f"y{a}").alias("y"), F.pmod(F.degrees(F.atan2((F.col(f"y{a}") - F.col(f"y{b}")).cast("double"), (F.col(f"x{a}") - F.col(f"x{b}")).cast("double"))), F.lit(360.0)).alias("bearing"))
    return segments.select("drawing_id", "seg_id", "layer", F.explode(F.array(out(1, 2), out(2, 1))).alias("e")).select("drawing_id", "seg_id", "layer", "e.*")


def endpoints(segments: DataFrame) -> DataFrame:
    """One row by point: degree, first layer (bridges do not count), bearings and segments in order."""
    own = F.when(F.col("layer") != "GAP_BRIDGE", F.col("layer"))
    return ends(segments).groupBy("drawing_id", "x", "y").agg(
        F.count("*").alias("degree"), F.min(own).alias("layer"), F.array_sort(F.collect_list("bearing")).alias("bearings"), F.array_sort(F.collect_set("seg_id")).alias("seg_ids")
    )


def free_ends(segments: DataFrame) -> DataFrame:
    return endpoints(segments).where("degree = 1").select("drawing_id", "x", "y", "layer", F.col("bearings")[0].alias("bearing"), F.col("seg_ids")[0].alias("seg_id"))


def ordered(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax < bx) | ((ax == bx) & (ay < by))


def pairs(free: DataFrame, reach: float, beyond: float = 0.0) -> DataFrame:
    """Pairs of free ends of different segments, the smaller point first, more than ``beyond`` and at most ``reach`` apart."""
    side = lambda p: free.select("drawing_id", *(F.col(c).alias(p + c) for c in ("x", "y", "layer", "bearing", "seg_id")))
    both = near_points(side("a"), side("b"), reach)
    both = both.where(ordered(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) & (F.col("aseg_id") != F.col("bseg_id")) & (F.col("d2") > max(beyond * beyond, 1e-18)))
    return both.withColumn("distance", F.sqrt(F.col("d2").cast("double"))).withColumn("delta", G.angle_delta(F.col("abearing"), F.col("bbearing")))


def gap_candidates(segments: DataFrame, tier1: float = 500.0, tier2: float | None = None, cost=G.bridge_cost) -> DataFrame:
    """Candidates up to ``tier1``; between the tiers only structural layer pairs, at a dearer cost."""
    found = pairs(free_ends(segments), tier2 or tier1)
    first = F.col("distance") <= tier1
    found = found.where(first | tier2_layer_pair(F.col("alayer"), F.col("blayer")))
    profile = G.is_wall_offset_profile(F.col("distance"), F.col("delta"))
    price = cost(F.col("distance"), F.col("delta")) + F.when(first, 0.0).otherwise(tier1 * 0.5)
    return found.withColumn("profile", profile).withColumn("micro", G.is_micro_gap(F.col("distance"), F.col("delta"))).withColumn("cost", price)


def nearest_other(free: DataFrame) -> DataFrame:
    """For each free end the nearest one of another segment of its drawing, however far, ties to the smaller point; null if there is none."""
    from tesselar.operators.cells import extent, widening
    from tesselar.operators.state import Steps

    key = ["drawing_id", "x", "y"]
    steps = Steps(free.sparkSession)
    free = steps.cut(free)
    b = free.select("drawing_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("seg_id").alias("bseg"))

    def found(left: DataFrame, reach: float) -> DataFrame:
        a = left.select("drawing_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("seg_id").alias("aseg"))
        near = near_points(a, b, reach).where("aseg <> bseg")
        return near.groupBy("drawing_id", F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.min(F.struct("d2", "bx", "by")).alias("n")).select(*key, "n.*")

    return free.join(widening(free, key, found, 500.0, extent(free), steps), key, "left")


def unique_pairs(candidates: DataFrame) -> DataFrame:
    """Pairs whose ends have no other candidate."""
    by_a, by_b = ["drawing_id", "ax", "ay"], ["drawing_id", "bx", "by"]
    ends_of = candidates.select("drawing_id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e"))
    once = ends_of.groupBy("drawing_id", "e.x", "e.y").count().where("count = 1").select("drawing_id", "x", "y")
    a = once.withColumnsRenamed({"x": "ax", "y": "ay"})
    b = once.withColumnsRenamed({"x": "bx", "y": "by"})
    return candidates.join(a, by_a, "left_semi").join(b, by_b, "left_semi")


def without_used(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """Candidates neither of whose ends is taken."""
    used = taken.select("drawing_id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("drawing_id", "e.x", "e.y").distinct()
    for p in "ab":
        candidates = candidates.join(used.withColumnsRenamed({"x": f"{p}x", "y": f"{p}y"}), ["drawing_id", f"{p}x", f"{p}y"], "left_anti")
    return candidates


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
