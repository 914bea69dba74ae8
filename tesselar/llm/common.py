"""What the text operators share: scratch tables, word splitting and hashing in Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step inside a task works on at once; a single longer text is one step of its own.
SLICE_BYTES = 1 << 20
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as rows can be whole documents of any length: the session's setting is lowered where it is larger (0: no limit).

    Results are computed later, so it cannot be put back here.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 500:
        spark.conf.set(name, "500")


# ---- scratch tables ---------------------------------------------------------------------------


class Scratch:
    """Tables written below ``spark.checkpoint.dir``, which all executors share.

    Writing cuts the lineage: what a lost executor had is read from the table again. The folder goes when the
    driver's Python ends; ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or "file:///tmp/checkpoints"  # one machine
        self.path = f"{base.rstrip('/')}/tesselar-{uuid.uuid4().hex}"  # a new folder by run
        atexit.register(self._remove, self.path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the shared folder's own clean-up takes it
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._remove(f"{self.path}/{name}")


def rows_by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose lists have one length, with these as a matrix."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(at)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[at[rows][:, None] + np.arange(n)]


def even_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to ``n`` rows, whatever size the session gives them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= n:
            whole = pa.Table.from_batches(held).combine_chunks()
            full = size - size % n
            for k in range(0, full, n):
                yield whole.slice(k, n).to_batches()[0]
            held, size = whole.slice(full).to_batches(), size - full
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# ---- arrays of texts ---------------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``rows`` rows and ``limit`` text bytes; a longer row is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        done = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, done + limit, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``limit`` text bytes, then cut again by ``slices``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(pc.sum(pc.binary_length(batch.column(column))).as_py() or 0)
        if size >= limit:
            for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from slices(whole, column, limit + limit // 4)
            held, size = [], 0
    if held:
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from slices(whole, column, limit + limit // 4)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of every text: offsets by text, a code by word, and the distinct words.

    ``lower`` turns A-Z to a-z first. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    values, offsets = parts.flatten(), parts.offsets.to_numpy()
    offsets = offsets - offsets[0]
    keep = np.asarray(pc.binary_length(values)) > 0
    if not keep.all():
        values = values.filter(pa.array(keep))
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    coded = values.dictionary_encode()
    return offsets.astype(np.int64), coded.indices.to_numpy(), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: A random value by byte and place; places beyond 64 take a multiple of them.
BY_PLACE = _seeds(256 * 64, 11).reshape(256, 64)
BY_BYTE = _seeds(256, 12)
PLACE_STEP = U(0xD6E8FEB86659FD93)


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and offsets from 0."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    buffers = strings.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind, count=strings.offset + len(strings) + 1)[strings.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every string: the sum of random values by byte and place, mixed with the length."""
    data, offsets = raw(strings)
    size = np.diff(offsets)
    out = np.zeros(len(size), U)
    if len(data):
        place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
        value = BY_PLACE[data, place & 63]
        if (far := place >> 6).any():
            value = value * (PLACE_STEP ** far.astype(U))
        full = size > 0
        out[full] = np.add.reduceat(value, offsets[:-1][full])
    return mix(out + size.astype(U) * U(0xA0761D6478BD642F) + U(seed))


def by_group(batches: Iterator[pa.RecordBatch], key: str, fn: Callable[[pa.Table], pa.Table | None], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Calls ``fn`` with rows of batches sorted by ``key``: whole groups only, many small ones at once."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1] + 1) if (keys != keys[-1]).any() else 0
        if last and (out := fn(whole.slice(0, last))) is not None:
            yield from out.to_batches()
        rest = whole.slice(last)
        held, n = rest.to_batches(), rest.num_rows
        rows = max(rows, 2 * n)
    if n and (out := fn(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield from out.to_batches()


def held_out(modulus: int, rest: int):
    """Whether crc32 of doc_id as text leaves ``rest``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


# ---- connected components ----------------------------------------------------------------------


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component_id): the smallest id reachable over the undirected ``links`` (a, b). Only linked ids come back.

    Alternates large stars and small stars, so the number of rounds grows with the logarithm of the longest chain.
    Every round is one aggregation and one join by id; a hub's rows are pre-aggregated and its join can be split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.write(edges, f"{name}-0")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    before = None
    k = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        k += 1
        large = scratch.write(large, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        k += 1
        edges = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("c")), F.struct(F.col("v").alias("id"), F.col("v").alias("c")))).alias("e"))
    return both.groupBy(F.col("e.id").alias("id")).agg(F.min("e.c").alias("component_id"))
