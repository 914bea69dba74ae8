"""Zones against the manifest, and bays against the slab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import geom as G
from tesselar.operators import overlay as O
from tesselar.plans.gates import TOLERANCE, all_zones
from tesselar.plans.registry import query

#: Fixed value: below what share of a bay, in per cent, its part inside the slab counts as low.
LOW_BAY = 25
#: The slab of the queries: from 3 to 42 m, without the corner beyond a slanted edge.
SLAB = [(3000, 3000), (42_000, 3000), (42_000, 30_000), (30_000, 42_000), (3000, 42_000)]


# ---- manifest -----------------------------------------------------------------------------------


def reconcile(zones: DataFrame, manifest: DataFrame, drawings: DataFrame) -> DataFrame:
    """By drawing and label of either side: expected and found area, faces, and whether they agree within the tolerance.

    ``zones``: drawing_id, label, area, faces; a label without a zone has found 0. ``manifest``: label, area_native, for every drawing; an area that is null
    or zero is not compared.
    """
    listed = drawings.select("drawing_id").distinct().withColumn("k", F.lit(0)).join(manifest.select("label", F.col("area_native").alias("expected"), F.lit(True).alias("listed"), F.lit(0).alias("k")), "k").drop("k")  # a manifest has some dozens of rows
    both = zones.select("drawing_id", "label", "area", "faces", F.lit(True).alias("built")).join(listed, ["drawing_id", "label"], "full_outer")
    found = F.coalesce("area", F.lit(0))
    has = F.coalesce(F.col("expected") > 0, F.lit(False))
    within = has & (F.abs(found - F.col("expected")) * 100 <= TOLERANCE * F.col("expected"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.select("drawing_id", "label", no("built"), no("listed"), "expected", found.cast("bigint").alias("found"), F.coalesce("faces", F.lit(0)).cast("bigint").alias("faces"), has.alias("has_area"), within.alias("within"))


def _reconciled(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    return reconcile(all_zones(faces, bays), manifest, faces)


STATE = "case when not listed then 'not in manifest' when not has_area then 'no area' when within then 'within tolerance' else 'outside tolerance' end"


@query("faces", "bays", "manifest_zones", sql=f"select drawing_id, label, expected, cast(found as bigint) as found, cast(faces as bigint) as faces, built, {STATE} as state from zone_reconciled")
def manifest_reconcile(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    return _reconciled(faces, bays, manifest).select("drawing_id", "label", "expected", "found", "faces", "built", F.expr(STATE).alias("state"))


STATUS = "case when not has_area then 'SKIP' when within then 'PASS' else 'REVIEW' end"


@query("faces", "bays", "manifest_zones", sql=f"select drawing_id, label, {STATUS} as status from zone_reconciled where built")
def manifest_overlay(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    """What is shown over each zone that was built."""
    return _reconciled(faces, bays, manifest).where("built").select("drawing_id", "label", F.expr(STATUS).alias("status"))


@query("faces", "bays", "manifest_zones", sql=f"select drawing_id, status, cast(count(*) as bigint) as zones from (select drawing_id, {STATUS} as status from zone_reconciled where built) s group by 1, 2")
def geometry_correctness(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest_overlay(faces, bays, manifest).groupBy("drawing_id", "status").agg(F.count("*").alias("zones"))


TOTALS = {
    "expected": "cast(sum(expected) as bigint)",
    "computed": "cast(sum(case when built then found else 0 end) as bigint)",
    "zones": "cast(sum(case when built then 1 else 0 end) as bigint)",
    "listed": "cast(sum(case when listed then 1 else 0 end) as bigint)",
    "with_area": "cast(sum(case when has_area then 1 else 0 end) as bigint)",
    "within_tolerance": "cast(sum(case when within then 1 else 0 end) as bigint)",
    "delta_pct": "round(100 * abs(cast(sum(case when built then found else 0 end) as double) - sum(expected)) / nullif(sum(expected), 0), 3)",
}


@query("faces", "bays", "manifest_zones", sql=f"select drawing_id, {', '.join(f'{e} as {n}' for n, e in TOTALS.items())} from zone_reconciled group by 1")
def manifest_totals(faces: DataFrame, bays: DataFrame, manifest: DataFrame) -> DataFrame:
    """By drawing: areas that the manifest states and that its zones have, how many of each, and how many agree."""
    return _reconciled(faces, bays, manifest).groupBy("drawing_id").agg(*(F.expr(e).alias(n) for n, e in TOTALS.items()))


# ---- bays inside the slab ---------------------------------------------------------------------------


def clipped(bays: DataFrame, slab: list[tuple[float, float]]) -> DataFrame:
    """bay_id, raw and clipped area, and the share in per cent, of bays inside a slab of any simple shape."""
    one = bays.sparkSession.createDataFrame([(0, [{"x": float(x), "y": float(y)} for x, y in slab])], "id long, ring array<struct<x:double,y:double>>")
    rings = bays.select(F.col("bay_id").alias("id"), G.rect_ring().alias("ring"))
    key = F.lit(0).alias("k")
    area = O.shared_areas(O.ring_edges(rings.select("id", "ring", key), "k", "id"), O.ring_edges(one.select("id", "ring", key), "k", "id"), keys=("k",), cell=10_000.0)
    raw = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    both = bays.select("bay_id", raw.alias("raw")).join(area.select(F.col("a").alias("bay_id"), F.round("shared", 3).alias("area")), "bay_id", "left").na.fill(0.0, ["area"])
    return both.withColumn("coverage", F.when(F.col("raw") > 0, 100 * F.col("area") / F.col("raw")).otherwise(0.0))


def valid_bay(bays: DataFrame) -> DataFrame:
    return bays.select("bay_id", G.ring_validity(G.rect_ring()).alias("valid"))


_RECT = "greatest(0, least(x1, 42000) - greatest(x0, 3000)) * greatest(0, least(y1, 42000) - greatest(y0, 3000))"
_BEYOND = " + ".join(f"({s} * case when {_RECT} > 0 then power(greatest(0, {x} + {y} - 72000), 2) / 2 else 0 end)" for s, x, y in ((1, "least(x1, 42000)", "least(y1, 42000)"), (-1, "greatest(x0, 3000)", "least(y1, 42000)"), (-1, "least(x1, 42000)", "greatest(y0, 3000)"), (1, "greatest(x0, 3000)", "greatest(y0, 3000)")))
CLIPPED = f"select bay_id, (x1 - x0) * (y1 - y0) as raw, {_RECT} - ({_BEYOND}) as area, x1 > x0 and y1 > y0 as valid from bays"
FLAGS = "concat_ws(',', case when area = 0 then 'empty_clip' end, case when area > 0 and 100 * area < 25 * raw then 'low_coverage' end, case when not valid then 'invalid_geometry' end)"


@query("bays", sql=f"select bay_id, cast(area as bigint) as area, round(100 * area / raw, 2) as coverage_pct from ({CLIPPED}) c")
def clip_bays(bays: DataFrame) -> DataFrame:
    return clipped(bays, SLAB).select("bay_id", F.round("area").cast("bigint").alias("area"), F.round("coverage", 2).alias("coverage_pct"))


def _flags() -> Column:
    low = (F.col("area") > 0) & (F.col("coverage") < LOW_BAY)
    return F.array_join(F.array_compact(F.array(F.when(F.col("area") == 0, "empty_clip"), F.when(low, "low_coverage"), F.when(~F.col("valid"), "invalid_geometry"))), ",")


@query("bays", sql=f"select bay_id, {FLAGS} as flags from ({CLIPPED}) c")
def bay_validation(bays: DataFrame) -> DataFrame:
    """Faults of bays inside the slab: nothing left, less than a quarter left, or a ring that is not valid."""
    return clipped(bays, SLAB).join(valid_bay(bays), "bay_id").select("bay_id", _flags().alias("flags"))


@query("bays", sql=f"select cast(count(*) as bigint) as bays, cast(count(*) filter (where not valid or area = 0) as bigint) as invalid, cast(count(*) filter (where area = 0) as bigint) as empty, cast(count(*) filter (where area > 0 and 100 * area < 25 * raw) as bigint) as low, cast(sum(raw) as bigint) as raw, cast(sum(area) as bigint) as clipped, round(avg(100.0 * area / raw), 2) as mean_coverage from ({CLIPPED}) c")
def bay_validation_summary(bays: DataFrame) -> DataFrame:
    v = clipped(bays, SLAB).join(valid_bay(bays), "bay_id")
    empty = F.col("area") == 0
    return v.agg(F.count("*").alias("bays"), F.count_if(~F.col("valid") | empty).alias("invalid"), F.count_if(empty).alias("empty"), F.count_if(~empty & (F.col("coverage") < LOW_BAY)).alias("low"), F.sum("raw").alias("raw"), F.round(F.sum("area")).cast("bigint").alias("clipped"), F.round(F.avg(F.when(F.col("raw") > 0, F.col("coverage"))), 2).alias("mean_coverage"))


@query("bays", sql=f"select bay_id, 'INT-' || bay_id as label, cast(area as bigint) as area, {FLAGS} as flags from ({CLIPPED}) c where area > 0")
def grid_geometry(bays: DataFrame) -> DataFrame:
    """Bays clipped to the slab, without empty ones, labelled and validated."""
    v = clipped(bays, SLAB).join(valid_bay(bays), "bay_id").where("area > 0")
    return v.select("bay_id", F.concat(F.lit("INT-"), F.col("bay_id").cast("string")).alias("label"), F.round("area").cast("bigint").alias("area"), _flags().alias("flags"))
