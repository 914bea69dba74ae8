"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are projected on the leading principal directions of a bounded sample and put into grid order: by label, length and cells as
wide as the distance that the cosine allows. The sequence is cut into blocks; eight neighbouring blocks form an interval, eight of these
a larger one, and so on up to one for each label and length. Intervals are joined from the top: a pair whose boxes in the projection lie
farther apart than the distance is skipped, and of any other the pairs of parts are tried next. Only boxes take part in this
recursion; vectors move for pairs of blocks that are left, and inside a task it goes on with parts of blocks before vectors are
compared in full dimension.

Equal vectors of a label are one point with a count, so a group of copies costs what one vector costs. A pair of intervals
gives back, for each point, how many it links with, and one tie: never the pairs themselves.

Where the leading directions hold little of the variance (vectors spread evenly over all directions), few boxes lie apart and most blocks of a
label are compared; results are the same, the work grows with the square of a label's vectors, in matrix products.

Edge cases: a null label, a null or zero vector, or one that holds null or non-finite components, links with nothing and
is kept; so does a row with a null vec_id (component_id null). Labels of any type that can be a string are compared as they are. Vectors of
different lengths never link, however many lengths there are. Repeated ids are rows of their own in n_links and share a component. Columns
other than the three are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm.common import Scratch, components, even_batches, rows_by_length, table


@dataclass(frozen=True)
class VectorConfig:
    cosine: float = 0.98
    directions: int = 6
    #: Vectors of a block and of its parts; blocks of an interval; intervals that one task joins with one.
    block: int = 1024
    part: int = 128
    fan: int = 8
    #: Vectors that principal directions are fitted on, for so many of the most frequent lengths. Any directions give right
    #: results: vectors of other lengths are ordered by their first coordinates.
    sample: int = 2000
    fitted: int = 16

    @property
    def epsilon(self) -> float:
        return float(np.sqrt(2 - 2 * self.cosine)) + 1e-9


def directions(points: DataFrame, cfg: VectorConfig) -> dict[int, np.ndarray]:
    """Principal directions of unit vectors, by length."""
    out = {}
    sizes = points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(cfg.fitted).collect()
    for dim in sorted(r.dim for r in sizes):
        sample = points.where(F.size("v") == dim).orderBy(F.xxhash64("point"), "point").limit(cfg.sample).select("v").toPandas()["v"]
        x = _unit(np.stack(sample.to_numpy()))
        _, vectors = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and dim > 1 else np.eye(dim))
        out[dim] = np.atleast_2d(vectors)[:, ::-1][:, : cfg.directions]
    return out


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    scaled = matrix / np.abs(matrix).max(axis=1)[:, None]  # huge and tiny components keep their norm finite
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _projected(unit: np.ndarray, bases: dict[int, np.ndarray], cfg: VectorConfig) -> np.ndarray:
    dim = unit.shape[1]
    x = unit @ bases.get(dim, np.eye(dim)[:, : cfg.directions])
    return np.pad(x, ((0, 0), (0, cfg.directions - x.shape[1])))


def blocks(points: DataFrame, bases: dict[int, np.ndarray], cfg: VectorConfig, scratch: Scratch) -> DataFrame:
    """Blocks of the grid order, one row each: number in the sequence, label, length, box of the projections, ids, counts and vectors."""
    cells = [f"c{j}" for j in range(cfg.directions)]
    bounds = [f"{s}{j}" for s in ("l", "h") for j in range(cfg.directions)]
    kind = points.schema["v"].dataType.elementType

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros((batch.num_rows, cfg.directions), np.int32)
            for rows, matrix in rows_by_length(batch.column(4)):
                cell[rows] = np.floor(_projected(_unit(matrix), bases, cfg) / cfg.epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, j]) for j in range(cfg.directions))], names=[*batch.schema.names, *cells])

    placed = points.select("lab", F.size("v").alias("dim"), "point", "n", "v")
    placed = placed.mapInArrow(project, T.StructType([*placed.schema.fields, *(T.StructField(c, T.IntegerType()) for c in cells)]))
    ordered = placed.repartitionByRange("lab", "dim", *cells, "point").sortWithinPartitions("lab", "dim", *cells, "point")
    names = ["task", "made", "lab", "dim", *bounds, "points", "counts", "vectors"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * len(bounds), pa.binary(), pa.binary(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in even_batches(batches, cfg.block):  # whatever the session's batches are
            lab, dim = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cut = [k for k in range(1, len(dim)) if lab[k] != lab[k - 1] or dim[k] != dim[k - 1]]
            for s, e in zip([0, *cut], [*cut, len(dim)], strict=True):
                for a in range(s, e, cfg.block):
                    b = min(a + cfg.block, e)
                    part = batch.slice(a, b - a)
                    matrix = part.column(4).flatten().to_numpy().reshape(b - a, dim[s])
                    x = _projected(_unit(matrix), bases, cfg)
                    row = [task, made, lab[s], int(dim[s]), *x.min(axis=0).tolist(), *x.max(axis=0).tolist(), part.column(2).to_numpy().tobytes(), part.column(3).to_numpy().tobytes(), matrix.tobytes()]
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    schema = "task int, made long, lab string, dim int, " + ", ".join(f"{b} double" for b in bounds) + ", points binary, counts binary, vectors binary"
    made = scratch.write(ordered.mapInArrow(pack, schema), "packed")
    # one row for each task of the sort: places in the whole sequence
    before = made.groupBy("task").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = made.join(before.select("task", "first"), "task").withColumn("block", F.col("first") + F.col("made")).withColumn("wide", F.lit(isinstance(kind, T.DoubleType)))
    return scratch.write(out.drop("task", "made", "first"), "blocks")


def near_pairs(sequence: DataFrame, cfg: VectorConfig, scratch: Scratch) -> DataFrame:
    """Pairs of blocks (a <= b) whose boxes lie within the distance, found by descending through pairs of intervals."""
    k = range(cfg.directions)
    sides = [f"{s}{j}" for s in "lh" for j in k]
    boxes = sequence.select("lab", "dim", "block", *sides)
    last = boxes.agg(F.max("block")).first()[0] or 0
    top = 0
    while last >= cfg.fan**top:
        top += 1

    def nodes(level: int) -> DataFrame:
        by = boxes.groupBy("lab", "dim", F.floor(F.col("block") / cfg.fan**level).cast("long").alias("node"))
        return by.agg(*(F.min(f"l{j}").alias(f"l{j}") for j in k), *(F.max(f"h{j}").alias(f"h{j}") for j in k))

    pairs = nodes(top).select("lab", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(top - 1, -1, -1):
        parts = nodes(level)
        side = lambda p: parts.select("lab", "dim", F.floor(F.col("node") / cfg.fan).cast("long").alias(p), F.col("node").alias(f"{p}n"), *(F.col(c).alias(f"{p}{c}") for c in sides))  # noqa: B023, E731
        gap = [F.greatest(F.col(f"al{j}") - F.col(f"bh{j}"), F.col(f"bl{j}") - F.col(f"ah{j}"), F.lit(0.0)) for j in k]
        near = sum((g * g for g in gap), F.lit(0.0)) <= cfg.epsilon**2 + 1e-9
        both = pairs.join(side("a"), ["lab", "dim", "a"]).join(side("b"), ["lab", "dim", "b"]).where((F.col("an") <= F.col("bn")) & near)
        pairs = scratch.write(both.select("lab", "dim", F.col("an").alias("a"), F.col("bn").alias("b")), f"pairs-{level}")
    return pairs.select("a", "b")


class Own:
    """Vectors of an interval's blocks, the links counted for them, and a label for what is connected."""

    def __init__(self):
        self.at: dict[int, slice] = {}
        self.parts: list[tuple] = []

    def add(self, block: int, part: tuple) -> None:
        start = sum(len(p[0]) for p in self.parts)
        self.at[block] = slice(start, start + len(part[0]))
        self.parts.append(part)

    def close(self) -> None:
        self.points, self.counts = (np.concatenate([p[k] for p in self.parts]) for k in range(2))
        self.links = np.zeros(len(self.points), np.int64)
        self.label = np.arange(len(self.points))


def _part_boxes(x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(x), part)
    return np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)


def compare(pairs: DataFrame, sequence: DataFrame, bases: dict[int, np.ndarray], cfg: VectorConfig) -> DataFrame:
    """point, n (rows it links with) and tie (a linked point, or null); a point comes once for each pair of intervals."""
    large = cfg.fan**2
    listed = pairs.groupBy(F.floor(F.col("a") / cfg.fan).cast("long").alias("g"), F.floor(F.col("b") / large).cast("long").alias("s"), F.col("b").alias("block")).agg(F.collect_list("a").alias("to"))
    content = ["block", "dim", "points", "counts", "vectors", "wide"]
    vectors = sequence.select(*content)
    other = listed.join(vectors, "block").select("g", "s", F.lit(1).alias("kind"), *content, "to")
    mine = listed.select("g", "s").distinct().join(vectors.withColumn("g", F.floor(F.col("block") / cfg.fan).cast("long")), "g")
    mine = mine.select("g", "s", F.lit(0).alias("kind"), *content, F.array().cast("array<bigint>").alias("to"))
    dealt = mine.unionByName(other).repartition("g", "s").sortWithinPartitions("g", "s", "kind", "block")

    def loaded(x: dict) -> tuple:
        unit = _unit(np.frombuffer(x["vectors"], np.float64 if x["wide"] else np.float32).reshape(-1, x["dim"]))
        return np.frombuffer(x["points"], np.int64), np.frombuffer(x["counts"], np.int64), unit, _part_boxes(_projected(unit, bases, cfg), cfg.part)

    def linked_blocks(m: tuple, n: tuple, same: bool) -> np.ndarray:
        """Which vectors of two blocks link: parts whose boxes lie apart are skipped."""
        (low, high), (blow, bhigh) = m[3], n[3]
        gap = np.maximum(np.maximum(low[:, None] - bhigh[None], blow[None] - high[:, None]), 0)
        close = (gap * gap).sum(axis=2) <= cfg.epsilon**2 + 1e-9
        near = np.zeros((len(m[0]), len(n[0])), bool)
        for i in np.flatnonzero(close.any(axis=1)):
            own = slice(i * cfg.part, (i + 1) * cfg.part)
            cols = np.flatnonzero(np.repeat(close[i], cfg.part)[: len(n[0])])
            near[own, cols] = m[2][own] @ n[2][cols].T >= cfg.cosine
        if same:
            np.fill_diagonal(near, False)
        return near

    def batch(points: np.ndarray, n: np.ndarray, tie: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(points), pa.array(n), pa.array(tie, mask=~some)], names=["point", "n", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, closed, by_block = None, Own(), False, {}

        def done() -> Iterator[pa.RecordBatch]:
            if closed:
                rows = np.flatnonzero(own.links)
                tie = own.points[own.label[rows]]
                yield batch(own.points[rows], own.links[rows], tie, tie != own.points[rows])

        for record in batches:
            for k in range(record.num_rows):
                x = record.slice(k, 1).to_pylist()[0]
                if (x["g"], x["s"]) != key:
                    yield from done()
                    key, own, closed, by_block = (x["g"], x["s"]), Own(), False, {}
                part = loaded(x)
                if x["kind"] == 0:
                    own.add(x["block"], part)
                    by_block[x["block"]] = part
                    continue
                if not closed:
                    own.close()
                    closed = True
                found = []
                for a in x["to"]:
                    near = linked_blocks(by_block[a], part, a == x["block"])
                    rows = np.flatnonzero(near.any(axis=1))
                    if len(rows):
                        found.append((own.at[a].start + rows, near[rows], a == x["block"]))
                        own.links[own.at[a].start + rows] += near[rows] @ part[1]
                if not found:
                    continue
                rows, near = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                none = len(own.points)
                while True:  # points of this interval that a vector of the block links with get one label
                    by_col = np.where(near, own.label[rows][:, None], none).min(axis=0)
                    low = np.where(near, by_col[None], none).min(axis=1)
                    to = np.arange(none)
                    np.minimum.at(to, own.label[rows], low)
                    while (to != to[to]).any():
                        to = to[to]
                    moved = to[own.label]
                    if (moved == own.label).all():
                        break
                    own.label = moved
                # a block joined with itself has its counts from the rows above
                counted = np.concatenate([np.full(len(f[0]), not f[2]) for f in found])
                cols = np.flatnonzero(near.any(axis=0))
                links = (near[:, cols] & counted[:, None]).T @ own.counts[rows]
                tie = own.points[by_col[cols]]
                yield batch(part[0][cols], links, tie, tie != part[0][cols])
        yield from done()

    return dealt.mapInArrow(run, "point long, n long, tie long")


def linked(vectors: DataFrame, cfg: VectorConfig = VectorConfig()) -> DataFrame:
    """vec_id, n_links, component_id, kept for rows (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession)
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine
    kind = vectors.schema["embedding"].dataType.elementType
    kind = kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()
    v = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(kind))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("lab"), F.when(part, v).alias("v"))
    seed = 0
    while True:  # ids of 64 bits that no two points share
        ident = F.xxhash64(F.lit(seed), "lab", "v")
        points = rows.where("v is not null").groupBy("lab", "v").agg(F.count("*").alias("n")).withColumn("point", ident)
        points = scratch.write(points, f"points-{seed}")
        if points.groupBy("point").count().where("count > 1").isEmpty():
            break
        seed += 1
    named = rows.withColumn("point", F.when(F.col("v").isNotNull(), ident)).select("vec_id", "point")
    bases = directions(points, cfg)
    sequence = blocks(points, bases, cfg, scratch)
    links = scratch.write(compare(near_pairs(sequence, cfg, scratch), sequence, bases, cfg), "links")
    counts = links.groupBy("point").agg(F.sum("n").alias("others"))
    tied = components(links.where("tie is not null").select(F.col("point").alias("a"), F.col("tie").alias("b")), scratch, "ties").withColumnRenamed("id", "point")
    whole = named.join(points.select("point", "n"), "point", "left").join(counts, "point", "left").join(tied, "point", "left").withColumn("c", F.coalesce("component_id", "point"))
    least = whole.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("low"))
    out = whole.drop("component_id").join(least, "c", "left")
    n_links = F.coalesce(F.col("n") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long")
    component = F.coalesce("low", "vec_id")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
