"""Predicates on polygon records and layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supported entity types, layer hints and detail layers.
SUPPORTED = ["LINE", "LWPOLYLINE", "POLYLINE", "ARC"]
ANNOTATION_HINTS = ["DIM", "TEXT", "HATCH", "DEFPOINT", "ANNOTATION", "NOTE", "GRID", "AXIS", "TITLE", "VIEWPORT", "NO_PLOT"]
STRUCTURAL = ["S-FNDN-1", "S-BEAM-1", "S-BEAM-2", "A-WALL", "A-WALL-2", "A-WALL-3"]
CROSS_PREFIX = [("S-FNDN-1", "S-BEAM"), ("S-FNDN-1", "A-WALL"), ("S-BEAM", "A-WALL")]
DETAIL_PREFIX = "A-DETL"
REVIEW_STATUSES = ["pending", "approved", "rejected", "needs_review"]
UNITS = {"mm": 0.001, "cm": 0.01, "m": 1.0}


def is_active(status: Column, excluded: Column) -> Column:
    return (F.coalesce(status, F.lit("active")) != "deleted") & ~F.coalesce(excluded, F.lit(False))


def is_obstacle(role: Column) -> Column:
    return F.coalesce(role, F.lit("partition")) == "obstacle"


def is_partition(status: Column, excluded: Column, role: Column) -> Column:
    return is_active(status, excluded) & ~is_obstacle(role)


def annotation_layer(layer: Column) -> Column:
    return F.upper(layer).rlike("|".join(ANNOTATION_HINTS))


def layer_kept(layer: Column, include: list[str], ignore: list[str]) -> Column:
    """In the include list (any layer, if that is empty) and not in the ignore list, whatever the case."""
    up = F.upper(layer)
    out = ~up.isin(*[x.upper() for x in ignore]) if ignore else F.lit(True)
    return out & up.isin(*[x.upper() for x in include]) if include else out


def structural(layer: Column) -> Column:
    name = F.upper(F.coalesce(layer, F.lit("0")))
    return name.isin(*STRUCTURAL) & ~name.startswith(DETAIL_PREFIX)


def tier2_layer_pair(a: Column, b: Column) -> Column:
    """Both structural, and one layer or prefixes that may meet, whatever the case."""
    a, b = F.upper(F.coalesce(a, F.lit("0"))), F.upper(F.coalesce(b, F.lit("0")))
    pair = F.lit(False)
    for p, q in CROSS_PREFIX:
        pair = pair | (a.startswith(p) & b.startswith(q)) | (a.startswith(q) & b.startswith(p))
    return structural(a) & structural(b) & ((a == b) | pair)


def normal_status(review: Column) -> Column:
    """Lower case with underscores; null when it is none of the four."""
    plain = F.regexp_replace(F.lower(F.trim(review)), r"[\s-]+", "_")
    return F.when(plain.isin(*REVIEW_STATUSES), plain)


def unit_scale(unit: Column) -> Column:
    """Metres for a drawing unit; an unknown one is an error."""
    out = F.when(unit == "mm", UNITS["mm"])
    for k in ("cm", "m"):
        out = out.when(unit == k, UNITS[k])
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown drawing unit: "), unit)).cast("double"))
