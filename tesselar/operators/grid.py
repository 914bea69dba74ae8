"""Grid frame: axis clusters, axis choice, bays and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions.geom import factor_pairs


def axis_clusters(lines: DataFrame, tolerance: float = 500.0) -> DataFrame:
    """Chains of positions with steps up to the tolerance: drawing_id, angle_deg, cluster, position (mean), lines."""
    order = Window.partitionBy("drawing_id", "angle_deg").orderBy("position_mm", "line_id")
    step = F.col("position_mm") - F.lag("position_mm").over(order)
    started = lines.withColumn("new", F.when(step <= tolerance, 0).otherwise(1))
    return (
        started.withColumn("cluster", F.sum("new").over(order)).groupBy("drawing_id", "angle_deg", "cluster").agg(F.avg("position_mm").alias("position"), F.count("*").alias("lines"))
    )


def axis_select(positions: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """cells + 1 evenly spaced of the ordered positions (rounded half to even), each once."""
    by = positions.groupBy(*keys).agg(F.array_sort(F.collect_list("position")).alias("all"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda k: F.bround(k * (F.size("all") - 1) / F.lit(cells)).cast("int")))
    return by.select(*keys, F.posexplode(F.transform(at, lambda k: F.element_at("all", k + 1))).alias("place", "position"))


def axis_target(counts: DataFrame, target: int) -> DataFrame:
    """For (drawing_id, nx, ny) axes: the factor pair of the target that both families can give, by the better smaller share of their axes; the first of
    equals, in the order of the smaller divisor's pair. Where no pair fits, all axes are taken, and the mode says so."""
    pairs = counts.select("*", F.explode(factor_pairs(F.lit(target).cast("bigint"))).alias("p")).where("p.a <= nx - 1 and p.b <= ny - 1")
    score = F.least((F.col("p.a") + 1) / F.col("nx"), (F.col("p.b") + 1) / F.col("ny"))
    best = F.max(F.struct(F.round(score, 9).alias("score"), (-F.least("p.a", "p.b")).alias("divisor"), (-F.col("p.a")).alias("first"), F.col("p.a").alias("a"), F.col("p.b").alias("b")))
    found = counts.join(pairs.groupBy("drawing_id").agg(best.alias("m")), "drawing_id", "left")
    cells = lambda m, n: F.coalesce(F.col(f"m.{m}"), F.greatest(F.col(n) - 1, F.lit(0))).cast("bigint")
    mode = F.when(F.col("m.a").isNull(), "raw_unmatched_target").otherwise(f"target_{target}")
    return found.select("drawing_id", cells("a", "nx").alias("columns"), cells("b", "ny").alias("rows"), mode.alias("mode"), F.col("m.score").alias("score"))


def bay_cells(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Rectangles between neighbouring axes of a drawing, numbered row by row."""
    span = lambda df, lo, hi, n: df.withColumn(hi, F.lead("position").over(Window.partitionBy("drawing_id").orderBy("position"))).where(F.col(hi).isNotNull()).select(
        "drawing_id", F.col("position").alias(lo), hi, (F.row_number().over(Window.partitionBy("drawing_id").orderBy("position")) - 1).alias(n)
    )
    cells = span(xs, "x0", "x1", "col_no").join(span(ys, "y0", "y1", "row_no"), "drawing_id")
    return cells.withColumn("bay_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("row_no", "col_no")))


def trim_bays(bays: DataFrame, target: int) -> DataFrame:
    """The target number of bays: empty ones go first, then the smallest."""
    order = Window.partitionBy("drawing_id").orderBy((F.col("area") == 0).cast("int"), F.col("area").desc(), "bay_id")
    return bays.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= target).drop("_r")
