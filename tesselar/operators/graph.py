"""Connected components: groups inside a task first, then label hooking and pointer jumping over what connects tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.operators.state import Steps

KEY = ["drawing_id", "ax", "ay", "bx", "by"]


def components(nodes: DataFrame, edges: DataFrame, steps: Steps) -> DataFrame:
    """(id, label): the smallest id reachable over the undirected ``edges`` (a, b). Ids are of any type that can be ordered.

    Every round takes over the neighbours' smallest label and follows it once, so rounds grow with the logarithm of the longest chain.
    """
    both = steps.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = steps.cut(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("label").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        hooked = label.join(near, label["id"] == near["a"], "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("m"))
        ahead = label.select(F.col("id").alias("m"), F.col("label").alias("far"))
        moved = hooked.join(ahead, "m").select("id", F.least("m", "far").alias("to"), "label")
        moved, n = steps.cut_and_count(moved.select("id", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moving")), F.col("moving"))
        label = moved.select("id", "label")
        if not n:
            return label


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every row's key in the order of the keys, and the first row of each key."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0..n-1 that each is tied to by the pairs a, b. Roots hook to smaller ones and pointers are followed: each round at least halves the roots of a group."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, a, b)
        np.minimum.at(label, b, a)
        while not np.array_equal(label, far := label[label]):
            label = far
        a, b = label[a], label[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return label


def linked_groups(links: DataFrame, steps: Steps, tile: int = 8000, mark: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows of ``links`` (drawing_id, ax, ay, bx, by and others) with gx, gy: the smallest point of their connected group.

    Links of a tile of the plane go to one task, which joins them into groups of its own; any deal of links to tasks would be right. Only points that
    several tasks have seen tie such groups, so the rounds of joins run over some thousandths of the links. ``mark`` adds a column ``close`` from the links of a
    task and the numbers of their ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        d, *xy = (rows.column(c).cast(pa.int64()).to_numpy() for c in KEY)
        number, first = numbered(np.tile(d, 2), *(np.concatenate([xy[k], xy[k + 2]]) for k in range(2)))
        a, b = number[: len(rows)], number[len(rows) :]
        root = first[joined(a, b, len(first))][a]
        for name, k in (("rx", 0), ("ry", 1)):
            rows = rows.append_column(name, pa.array(np.concatenate([xy[k], xy[k + 2]])[root]))
        new = np.zeros(len(number), bool)
        new[first] = True
        rows = rows.append_column("na", pa.array(new[: len(rows)])).append_column("nb", pa.array(new[len(rows) :]))
        if mark:
            rows = rows.append_column("close", pa.array(mark(rows, a, b)))
        yield from rows.to_batches(max_chunksize=100_000)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema.fields)
    near = links.repartition(steps.tasks(), "drawing_id", F.floor(F.col("ax") / tile), F.floor(F.col("ay") / tile))
    rooted = steps.cut(near.mapInArrow(run, f"{kinds}, rx long, ry long, na boolean, nb boolean" + (", close boolean" if mark else "")))
    point = lambda x, y: F.struct("drawing_id", F.col(x).alias("x"), F.col(y).alias("y"))
    # a task names each of its points once
    side = lambda p: rooted.where(f"n{p}").select(point(f"{p}x", f"{p}y").alias("p"), point("rx", "ry").alias("r"))
    seen = side("a").unionByName(side("b"))
    rooted = rooted.drop("na", "nb")
    roots = seen.groupBy("p").agg(F.collect_set("r").alias("r")).where(F.size("r") > 1)  # one by task that has the point
    ties = steps.cut(roots.select(F.array_min("r").alias("a"), F.explode("r").alias("b")).where("a <> b").distinct())
    if ties.isEmpty():
        return rooted.withColumnsRenamed({"rx": "gx", "ry": "gy"})
    nodes = ties.select(F.col("a").alias("id")).union(ties.select("b")).distinct()
    label = components(nodes, ties, steps).select("id.drawing_id", F.col("id.x").alias("rx"), F.col("id.y").alias("ry"), F.col("label.x").alias("gx"), F.col("label.y").alias("gy"))
    out = rooted.join(label, ["drawing_id", "rx", "ry"], "left")
    return out.withColumns({"gx": F.coalesce("gx", "rx"), "gy": F.coalesce("gy", "ry")}).drop("rx", "ry")
