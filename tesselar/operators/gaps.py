"""Free ends paired into gaps, their status, and why a gap within the threshold stays open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.operators import endpoints as E
from tesselar.operators.matching import KEY, mutual_pairs
from tesselar.operators.state import Steps, shared

#: How far free ends are paired, and the priority of each status.
REACH = 10_000.0
PRIORITY = {"within_threshold_unclosed": 100, "above_threshold_close": 80, "orphan_endpoint": 60, "large_gap_manual_review": 40}
PAIRING, BEARING = "greedy_pairing_conflict", "bearing_mismatch_suspected"


def status(distance: Column, threshold: float) -> Column:
    near = F.when(distance <= threshold, "within_threshold_unclosed").when(distance <= 2 * threshold, "above_threshold_close")
    return F.when(distance.isNull(), "orphan_endpoint").otherwise(near.otherwise("large_gap_manual_review"))


def gaps(segments: DataFrame, threshold: float = 500.0) -> DataFrame:
    """drawing_id, ax, ay, bx, by, d2, distance, alayer, blayer, delta, status: each free end is in one row.

    The nearest pair of all is taken first, then the nearest of the ends left, up to REACH; whoever is left then is an orphan. Pairs are taken
    reach by reach: once all within a reach are taken, the ends left lie farther apart than it, so each has but some dozens of
    others within four times the reach, however dense the drawing is.
    """
    return shared(f"gaps-{threshold:g}", lambda s: _gaps(s, threshold), segments)


def _gaps(segments: DataFrame, threshold: float) -> DataFrame:
    steps = Steps(segments.sparkSession)
    free = steps.cut(E.free_ends(segments))
    left, taken, reach = free, [], REACH / 64  # four reaches
    while reach <= REACH:
        near, n = steps.cut_and_count(E.pairs(left, reach).withColumn("cost", F.col("d2").cast("double")), F.lit(True))
        if n:
            pairs = steps.cut(mutual_pairs(near).join(near.drop("cost", "distance"), KEY))
            taken.append(pairs.select(*KEY, "d2", "distance", "alayer", "blayer", "delta"))
            left = steps.cut(without(left, pairs))
        reach *= 4
    none = F.lit(None)
    lone = left.select("drawing_id", F.col("x").alias("ax"), F.col("y").alias("ay"), none.cast("bigint").alias("bx"), none.cast("bigint").alias("by"), none.cast("bigint").alias("d2"), none.cast("double").alias("distance"), F.col("layer").alias("alayer"), F.lit("").alias("blayer"), none.cast("double").alias("delta"))
    for t in taken:
        lone = lone.unionByName(t)
    return lone.withColumn("status", status(F.col("distance"), threshold))


def without(ends: DataFrame, pairs: DataFrame) -> DataFrame:
    used = pairs.select("drawing_id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e"))
    return ends.join(used.select("drawing_id", "e.x", "e.y"), ["drawing_id", "x", "y"], "left_anti")


def failures(found: DataFrame, max_angle: float = G.MAX_GAP_ANGLE) -> DataFrame:
    """Gaps within the threshold with the reason why they are open: a large turn, else another pairing."""
    reason = F.when(F.col("delta") > max_angle + 45, BEARING).otherwise(PAIRING)
    return found.where("status = 'within_threshold_unclosed'").withColumn("reason", reason)


def priority(of: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))[of]
