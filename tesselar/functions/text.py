"""String, flag and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def region_label_text(label: Column, area: Column, volume: Column) -> Column:
    return F.format_string("%s\nArea: %.2f m2\nVol: %.2f m3", label, area, volume)


def zone_label_text(label: Column, bays: Column, area: Column, volume: Column) -> Column:
    return F.format_string("%s\nBays: %d\nArea: %.2f m2\nVol: %.2f m3", label, bays, area, volume)


def label_number(label: Column) -> Column:
    """The number after the dash, 0 without one."""
    return F.coalesce(F.split_part(label, F.lit("-"), F.lit(2)).try_cast("bigint"), F.lit(0).cast("bigint"))


def label_in_text(label: Column, text: Column) -> Column:
    """Whether the text holds the label as a whole word."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![0-9A-Za-z-])"), label, F.lit(r"(?![0-9A-Za-z-])")))


def layer_pair_text(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.trim(a), F.trim(b))


def gap_reason_text(status: Column, distance: Column, reason: Column) -> Column:
    """Parts that are null are left out."""
    return F.concat_ws("; ", F.concat(F.lit("Gap status: "), status), F.concat(F.lit("distance="), F.round(distance, 3).cast("string")), F.concat(F.lit("failure_reason="), reason))


def truncate_ellipsis(text: Column, n: int = 60) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def yn_flag(text: Column) -> Column:
    """True for Y, false for N, null otherwise."""
    plain = F.upper(F.trim(text))
    return F.when(plain == "Y", True).when(plain == "N", False)


def normalize_source_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1))


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
