"""Lengths of lines along the axes inside boxes, summed by layer without a row for each pair of a line and a box."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Height of the strips by which lines and boxes go to tasks.
STRIP = 2000


def below(values: np.ndarray, ranks: np.ndarray, bounds: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first ``ranks`` values are below ``bounds`` (side left; right: not above), and the sum of these.

    The first r values are one block for each bit of r; in each block values are sorted, so a bound is searched once for each bit.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    rising = values[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    bound = np.searchsorted(rising, bounds, side=side).astype(np.int64)
    count, total = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), rising.dtype)
    for level in range(n.bit_length()):
        at = np.flatnonzero((ranks >> level) & 1)
        if not len(at):
            continue
        keys = np.sort((np.arange(n, dtype=np.int64) >> level) * (n + 1) + rank)
        sums = np.concatenate([np.zeros(1, rising.dtype), np.cumsum(rising[keys % (n + 1)])])
        block = (ranks[at] >> (level + 1)) << 1
        low, high = block << level, np.searchsorted(keys, block * (n + 1) + bound[at])
        count[at] += high - low
        total[at] += sums[high] - sums[low]
    return count, total


def _strip(lines: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    parts = []
    if len(lines) and len(boxes):
        codes, layers = pd.factorize(lines["layer"], use_na_sentinel=False)
        side = {c: boxes[c].to_numpy() for c in ("a0", "a1", "v0", "v1")}
        for k, layer in enumerate(layers):
            own = lines[codes == k].sort_values("v", kind="stable")
            a, b, v = (own[c].to_numpy() for c in "abv")
            r = {"0": np.searchsorted(v, side["v0"], side="left"), "1": np.searchsorted(v, side["v1"], side="right")}
            at = np.flatnonzero((r["0"] < r["1"]) & (side["a0"] <= b.max()) & (side["a1"] >= a.min()))
            if not len(at):
                continue
            ranks = np.concatenate([r["1"][at], r["0"][at]])
            length, n = 0, 0
            # what a line has below x is (x - a) from its start on, less (x - b) from its end on
            for values, sign, starts in ((a, 1, True), (b, -1, False)):
                for edge, way in (("a1", 1), ("a0", -1)):
                    x = side[edge][at]
                    count, total = below(values, ranks, np.concatenate([x, x]), "right" if edge == "a1" else "left")
                    m = len(at)
                    count, total = count[:m] - count[m:], total[:m] - total[m:]
                    length = length + sign * way * (x * count - total)
                    if starts == (edge == "a1"):
                        n = n + sign * count
            some = n > 0
            parts.append((boxes["face_id"].to_numpy()[at][some], np.full(int(some.sum()), None if pd.isna(layer) else layer, object), length[some]))
    faces, layers, lengths = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else ([], [], [])
    return pd.DataFrame({"face_id": faces, "layer": pd.Series(layers, dtype=object), "length": lengths})


def lengths_in_boxes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """face_id, layer and the length of the layer's lines inside each box (face_id, x0, y0, x1, y1), border included; a row wherever a line meets the box.

    Lines (x1, y1, x2, y2, layer) are along an axis with rising ends, all numbers are integers. Lines go to strips along them, boxes to all strips that they meet; there
    sums over sorted lines give each box its answer, so the work grows with lines and boxes, not with their pairs.
    """
    flat = F.col("y1") == F.col("y2")
    pick = lambda x, y: F.when(flat, F.col(x)).otherwise(F.col(y))
    own = lines.select("drawing_id", flat.alias("flat"), "layer", pick("x1", "y1").alias("a"), pick("x2", "y2").alias("b"), pick("y1", "x1").alias("v"))
    own = own.withColumn("strip", F.floor(F.col("v") / STRIP))
    both = F.array(*(F.struct(F.lit(f).alias("flat"), *(F.col(c + k).alias(n + k) for c, n in zip(order, "av", strict=True) for k in "01")) for f, order in ((True, "xy"), (False, "yx"))))
    asked = boxes.select("drawing_id", "face_id", F.explode(both).alias("s")).select("drawing_id", "face_id", "s.*")
    asked = asked.withColumn("strip", F.explode(F.sequence(F.floor(F.col("v0") / STRIP), F.floor(F.col("v1") / STRIP))))
    on = ["drawing_id", "flat", "strip"]
    return own.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(_strip, "face_id long, layer string, length long").groupBy("face_id", "layer").agg(F.sum("length").alias("length"))
