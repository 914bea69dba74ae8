"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, floor(scale * x), once; they are written to the shared folder and every round reads them. A round is one job. Inside
a task, for each dimension, the integer values that occur there get a row of a table: the squared difference of the value to every
centroid. A vector's distances are then gathers from these tables, summed over the dimensions; no product or square is taken for a
vector. Where values lie close together the table covers their range and the value is the place in it, otherwise they are looked up
among the distinct values.

A task gives back for each centroid a count and one sum for each dimension; Spark adds these up, and only clusters x (dimensions + 1) numbers
reach the driver, whatever the number of vectors. Sums and floors are exact integers, so results depend neither on partitions nor on
the order of rows. Equal vectors need no care: they cost what any vectors cost and meet in no group.

Edge cases: vectors that are null, of another length, or that hold null or non-finite components are left out. Repeated rows and ids are vectors of
their own. A null vec_id is kept; it comes after all others when centroids are chosen, and equal ids are ordered by their components. With fewer
vectors than clusters there are as many centroids as vectors. Ties go to the smaller number, empty clusters keep their centroid. Integers
beyond 2^27 raise an error, as their squared distances leave 64 bits. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import Scratch, even_batches, table

LARGEST = 1 << 27


@dataclass(frozen=True)
class ClusterConfig:
    clusters: int = 8
    dims: int = 64
    scale: int = 1024
    rounds: int = 10
    #: Text put before the id whose sha256 orders the first centroids.
    salt: str = "3:"
    #: Vectors that share a table inside a task, and up to what range of values a table covers all of them.
    block: int = 8192
    width: int = 1 << 14


def integers(embeddings: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """vec_id and v (array of integers) of the vectors that take part."""
    x = F.col("embedding")
    fit = (F.size(x) == cfg.dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: c.cast("double") * cfg.scale)
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) > LARGEST, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.floor(c).cast("int")))
    return embeddings.where(F.coalesce(fit, F.lit(False))).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, cfg: ClusterConfig) -> np.ndarray:
    """The vectors whose salted ids have the smallest hashes: a top-k of as many rows as there are clusters."""
    h = F.sha2(F.concat(F.lit(cfg.salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(cfg.clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), cfg.dims)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].reshape(-1, dims)


def distances(block: np.ndarray, centroids: np.ndarray, width: int) -> np.ndarray:
    """Squared distances (vector, centroid) by one table of scalars for each dimension."""
    out = np.zeros((len(block), len(centroids)), np.int64)
    low, high = block.min(axis=0).astype(np.int64), block.max(axis=0).astype(np.int64)
    for d in range(block.shape[1]):
        values = block[:, d]
        if high[d] - low[d] < width:
            occurring, place = np.arange(low[d], high[d] + 1), values - low[d]
        else:
            occurring, place = np.unique(values, return_inverse=True)
        lookup = occurring.astype(np.int64)[:, None] - centroids[None, :, d]
        lookup *= lookup
        out += lookup[place]
    return out


def sums(vectors: DataFrame, centroids: np.ndarray, cfg: ClusterConfig) -> dict[int, tuple[int, list[int]]]:
    """By cluster its vectors' count and componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), cfg.dims), np.int64)
        for part in even_batches(batches, cfg.block):
            block = matrix(part.column(0), cfg.dims)
            near = distances(block, centroids, cfg.width).argmin(axis=1)
            for c in np.unique(near):
                mine = block[near == c]
                count[c] += len(mine)
                total[c] += mine.sum(axis=0, dtype=np.int64)
        live = np.flatnonzero(count)
        if len(live):
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total[live].reshape(-1)), cfg.dims).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(count[live]), lists], names=["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, total array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(cfg.dims)))
    return {r["cluster"]: (r["n"], [r[f"s{d}"] for d in range(cfg.dims)]) for r in added.collect()}


def fit(vectors: DataFrame, cfg: ClusterConfig) -> np.ndarray:
    centroids = first_centroids(vectors, cfg)
    if not len(centroids):
        return centroids
    for _ in range(cfg.rounds):
        before = centroids
        centroids = before.copy()
        for c, (n, total) in sums(vectors, before, cfg).items():
            centroids[c] = [s // n for s in total]
        if (centroids == before).all():
            break  # further rounds change nothing
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray, cfg: ClusterConfig) -> DataFrame:
    """vec_id, cluster, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in even_batches(batches, cfg.block):
            d = distances(matrix(part.column(1), cfg.dims), centroids, cfg.width)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(embeddings: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the centroids."""
    scratch = Scratch(embeddings.sparkSession)
    vectors = scratch.write(integers(embeddings, cfg), "integers")
    centroids = fit(vectors, cfg)
    return scratch.write(assigned(vectors, centroids, cfg), "assigned"), centroids


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = ClusterConfig()
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"), cfg)
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # one row by cluster
    by = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1) if values else F.lit(None).cast(kind)
    return rows.select(
        "vec_id", "cluster", "distance",
        by([each.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(each.values())).cast("long").alias("inertia"),
        by(text, "string").alias("centroid_sha256"),
    )


def _sql(cfg: ClusterConfig = ClusterConfig()) -> str:
    """Every round as a table of (cluster, dimension, value)."""
    near = lambda c: f"""select distinct on (rid) rid, c, d from (
        select e.rid, k.c, cast(sum((e.x - k.x) * (e.x - k.x)) as bigint) as d from e join {c} k on k.i = e.i group by e.rid, k.c) t order by rid, d, c"""  # noqa: E731
    out = f"""
with kept as materialized (
    select row_number() over (order by sha256('{cfg.salt}' || cast(vec_id as varchar)) nulls last, embedding) as rid, vec_id, embedding
    from embeddings
    where len(embedding) = {cfg.dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), e as materialized (
    select rid, i, cast(floor({cfg.scale} * cast(embedding[i] as double)) as bigint) as x
    from (select rid, embedding, unnest(range(1, {cfg.dims + 1})) as i from kept) t
), c0 as materialized (
    select cast(rid - 1 as integer) as c, i, x from e where rid <= {cfg.clusters}
)"""
    for k in range(1, cfg.rounds + 1):
        out += f""", n{k} as materialized (
    {near(f"c{k - 1}")}
), c{k} as materialized (
    select p.c, p.i, coalesce(s.x, p.x) as x from c{k - 1} p left join (
        select c, i, cast((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) as bigint) as x from n{k} join e using (rid) group by c, i
    ) s on s.c = p.c and s.i = p.i
)"""
    last = f"c{cfg.rounds}"
    return out + f""", final as materialized (
    {near(last)}
), names as (
    select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as h from {last} group by c
)
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, h as centroid_sha256
from final join kept using (rid) join names using (c)
"""


SQL = _sql()
