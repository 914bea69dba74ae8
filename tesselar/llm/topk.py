"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are turned to the principal directions of a bounded sample (an inner product stays what it is) and cut into segments. The mean
and the deviation of each segment bound the inner product from above, which is the same as a distance from below: for a segment of
length L it is at most L (mean mean' + dev dev'). Segments are long at the first level and short at the last.

1. Rows and queries are put into blocks in the order of their leading directions. A block keeps the ranges of its means and the largest
   deviations; these statistics alone meet for all pairs of blocks, and give each pair a bound.
2. Each query block is compared with the row block of the largest bound. The k-th best scores are the first floors.
3. Pairs of blocks whose bound does not reach the lowest floor of the query block are skipped before any vector moves.
4. In the others, pairs of vectors go through the levels, coarse to fine, and what survives the last one is computed exactly in integers.

Queries and rows of a block that have no pair left drop out of it; pairs of the rest are one product of matrices, of which only survivors count.
Where vectors have no structure at all, no block is skipped and only the last level (segments of two) skips pairs: of 51,282 vectors
of 64 independent components 31 % of all pairs survive it. As its bounds cost what exact scores cost, nothing is gained there.

Edge cases: vectors that are null, empty or hold null or non-finite components, or whose id is null, take no part; rows of another
length than the query's are no candidates for it; fewer than k candidates give all of them; ties go to the smaller id;
repeated ids are each compared, but never with a query of that id. Scores or components beyond 64 bits are an error. Columns other than
the two are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm.common import Scratch, even_batches, rows_by_length, table


@dataclass(frozen=True)
class TopkConfig:
    k: int = 20
    scale: int = 64
    #: Lengths of segments, coarse to fine; the one that blocks are judged by, whose statistics cost little next to their vectors.
    levels: tuple[int, ...] = (16, 4, 2)
    judged: int = 1
    #: Rows and queries of a block; row blocks that one task goes through in turn; rows between two rises of the floor.
    rows: int = 2048
    queries: int = 2048
    run: int = 16
    step: int = 512
    #: Vectors that the principal directions are fitted on, for so many of the most frequent lengths; others are not turned.
    sample: int = 2000
    fitted: int = 16
    leading: int = 4


def statistics(turned: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment means and deviations, both times the root of the segment's length."""
    at = np.arange(0, turned.shape[1], length)
    n = np.diff(np.append(at, turned.shape[1]))
    mean = np.add.reduceat(turned, at, axis=1) / n
    square = np.add.reduceat(turned * turned, at, axis=1) / n
    return np.sqrt(n) * mean, np.sqrt(n * np.maximum(square - mean * mean, 0))


class Best:
    """The best scores of a block of queries so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, basis: np.ndarray, cfg: TopkConfig, floor: np.ndarray | None = None):
        self.ids, self.matrix, self.basis, self.cfg = ids, matrix, basis, cfg
        turned = matrix.astype(np.float64) @ basis
        self.levels = [np.concatenate(statistics(turned, n), axis=1) for n in cfg.levels]
        self.norm = np.sqrt((turned * turned).sum(axis=1)).max(initial=0)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.found = [np.zeros(0, np.int64)] * 3
        self.pairs = self.exact = 0

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for s in range(0, len(ids), self.cfg.step):
            self._add(ids[s : s + self.cfg.step], matrix[s : s + self.cfg.step])

    def _survivors(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and rows with a pair left, and which pairs of them are."""
        slack = 1e-9 * self.norm * np.sqrt((turned * turned).sum(axis=1)).max() + 1e-6
        q, r = np.arange(len(self.ids)), np.arange(len(turned))
        keep = np.ones((len(q), len(r)), bool)
        for own, length in zip(self.levels, self.cfg.levels, strict=True):
            if not keep.size:
                break
            other = np.concatenate(statistics(turned[r], length), axis=1)
            keep &= own[q] @ other.T >= (self.floor[q] - slack)[:, None]
            some, rows = keep.any(axis=1), keep.any(axis=0)
            q, r = q[some], r[rows]
            keep = keep if some.all() and rows.all() else keep[np.ix_(some, rows)]
        return q, r, keep

    def _scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of all rows of a with all of b."""
        most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
        if most < 1 << 53:  # whole numbers that a double holds
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        if most < 1 << 63:
            return a @ b.T
        whole = a.astype(object) @ b.astype(object).T
        if max(map(abs, whole.ravel()), default=0) >= 1 << 63:
            raise OverflowError("an inner product does not fit 64 bits")
        return whole.astype(np.int64)

    def _add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        q, r, keep = self._survivors(matrix.astype(np.float64) @ self.basis)
        self.pairs += len(self.ids) * len(ids)
        self.exact += int(keep.sum())
        if not keep.size:
            return
        scores = self._scores(self.matrix[q], matrix[r])
        i, j = np.nonzero(keep & (scores >= self.floor[q][:, None]))
        score, q, r = scores[i, j], q[i], r[j]
        keep = self.ids[q] != ids[r]
        q, r, score = (np.concatenate(x) for x in zip(self.found, (q[keep], ids[r][keep], score[keep]), strict=True))
        by = np.lexsort((r, -score, q))
        q, r, score = q[by], r[by], score[by]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.ids)))[q]
        last = place == self.cfg.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.found = [x[place < self.cfg.k] for x in (q, r, score)]


def _small(matrix: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them."""
    most = int(max(matrix.max(initial=0), -(matrix.min(initial=0) + 1)))
    return matrix.astype(next(t for t, bits in ((np.int8, 7), (np.int16, 15), (np.int32, 31), (np.int64, 63)) if most < 1 << bits)).tobytes()


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (rows * dim)}").reshape(rows, dim).astype(np.int64)


def directions(whole: DataFrame, cfg: TopkConfig) -> dict[int, tuple[np.ndarray, float]]:
    """Principal directions of the vectors about zero, by length: all of them, so that turning keeps inner products; and a cell's width."""
    out = {}
    for (dim, _) in whole.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(cfg.fitted).collect():
        sample = whole.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(cfg.sample).select("v").toPandas()["v"]
        x = np.stack(sample.to_numpy()).astype(np.float64)
        out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1], float(np.sqrt((x * x).sum(axis=1)).mean() / 8) or 1.0
    return out


def _basis(bases: dict[int, tuple[np.ndarray, float]], dim: int) -> tuple[np.ndarray, float]:
    return bases[dim] if dim in bases else (np.eye(dim), 16.0)


class Steps:
    """Blocks of rows and queries, their pairs with bounds, and what is left of these after the first floors."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, cfg: TopkConfig):
        self.cfg, self.scratch = cfg, Scratch(vectors.sparkSession)
        whole = self._whole(vectors)
        self.bases = directions(whole, cfg)
        self.rows = self.scratch.write(self._blocks(whole, cfg.rows), "rows")
        self.queries = self.scratch.write(self._blocks(self._whole(queries), cfg.queries), "queries")
        self.runs = max(1, -(-self.rows.count() // cfg.run))
        a = self.queries.select("dim", F.col("block").alias("q"), *(F.col(c).alias(f"q{c}") for c in ("low", "high", "dev")))
        b = self.rows.select("dim", "block", "low", "high", "dev")
        products = [F.zip_with(x, y, lambda s, t: s * t) for x in ("qlow", "qhigh") for y in ("low", "high")]
        largest = products[0]
        for p in products[1:]:
            largest = F.zip_with(largest, p, lambda s, t: F.greatest(s, t))
        terms = F.zip_with(largest, F.zip_with("qdev", "dev", lambda s, t: s * t), lambda s, t: s + t)
        size = F.aggregate(F.zip_with("qdev", "dev", lambda s, t: s * t), F.lit(1.0), lambda s, t: s + t)
        bound = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
        self.pairs = self.scratch.write(a.join(b, "dim").select("q", "block", (bound + 1e-9 * (F.abs(bound) + size) + 1e-6).alias("bound")), "pairs")
        first = self.pairs.groupBy("q").agg(F.max(F.struct("bound", "block")).alias("m")).select("q", F.col("m.block").alias("block"), F.col("m.bound").alias("bound"))
        self.first = self.scratch.write(first, "first")
        self.seeds = self.scratch.write(self._scan(self.first, None), "seeds")
        ranks = self.seeds.groupBy("q", "place").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        floors = ranks.select("q", "place", F.when(F.col("n") >= cfg.k, F.col("floor").cast("double")).otherwise(float("-inf")).alias("floor"))
        n = self.queries.select(F.col("block").alias("q"), (F.octet_length("ids") / 8).alias("of"))
        # by query block one array, as long as the block
        by = floors.groupBy("q").agg(F.collect_list(F.struct("place", "floor")).alias("floors"), F.min("floor").alias("least"), F.count("*").alias("with"))
        self.floors = self.scratch.write(n.join(by, "q", "left").select("q", "floors", F.when(F.col("with") == F.col("of"), F.col("least")).otherwise(float("-inf")).alias("least")), "floors")

    def _whole(self, df: DataFrame) -> DataFrame:
        fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        scaled = lambda x: F.floor(x.cast("double") * self.cfg.scale)
        fits = lambda x: F.when(F.abs(x.cast("double") * self.cfg.scale) < 2.0**62, scaled(x)).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
        return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", fits).alias("v"))

    def _blocks(self, whole: DataFrame, most: int) -> DataFrame:
        """One row by block: id, length, vec_ids, vectors, and by segment the range of means and the largest deviation."""
        cfg, bases = self.cfg, self.bases
        cells = [f"c{j}" for j in range(cfg.leading)]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.zeros((batch.num_rows, cfg.leading), np.int64)
                for rows, matrix in rows_by_length(batch.column(1)):
                    basis, width = _basis(bases, matrix.shape[1])
                    x = matrix.astype(np.float64) @ basis[:, : cfg.leading]
                    cell[rows, : x.shape[1]] = np.floor(x / width)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, j]) for j in range(cfg.leading))], names=["vec_id", "v", *cells])

        placed = whole.mapInArrow(project, T.StructType([*whole.schema.fields, *(T.StructField(c, T.LongType()) for c in cells)])).withColumn("dim", F.size("v"))
        ordered = placed.repartitionByRange("dim", *cells, "vec_id").sortWithinPartitions("dim", *cells, "vec_id")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in even_batches(batches, most):  # whatever the session's batches are
                dim = batch.column(batch.schema.get_field_index("dim")).to_numpy()
                cut = np.flatnonzero(np.diff(dim)) + 1
                for s, e in zip([0, *cut], [*cut, len(dim)], strict=True):
                    for a in range(s, e, most):
                        part = batch.slice(a, min(a + most, e) - a)
                        matrix = part.column(1).flatten().to_numpy().reshape(part.num_rows, dim[s])
                        mean, dev = statistics(matrix.astype(np.float64) @ _basis(bases, int(dim[s]))[0], cfg.judged)
                        row = [int(dim[s]), part.column(0).to_numpy().tobytes(), _small(matrix), mean.min(axis=0).tolist(), mean.max(axis=0).tolist(), dev.max(axis=0).tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["dim", "ids", "matrix", "low", "high", "dev"])

        kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.float64())] * 3]
        return ordered.mapInArrow(pack, "dim int, ids binary, matrix binary, low array<double>, high array<double>, dev array<double>").withColumn("block", F.monotonically_increasing_id())

    def rest(self) -> DataFrame:
        """Pairs of blocks, the first of each query block left out, that may hold one of its k best."""
        open_pairs = self.pairs.join(self.first.select("q", "block"), ["q", "block"], "left_anti")
        return open_pairs.join(self.floors.select("q", "least"), "q").where(F.col("bound") >= F.col("least")).select("q", "block", "bound")

    def _scan(self, pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        """q, place (of the query in its block), query_id, vec_id, score: the best of each query in a run of row blocks."""
        cfg, bases = self.cfg, self.bases
        none = F.lit(None).cast("array<struct<place:int,floor:double>>")
        dealt = pairs.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(self.runs)))
        asked = self.queries.select(F.col("block").alias("q"), "dim", "ids", "matrix")
        asked = asked.withColumn("floors", none) if floors is None else asked.join(floors.select("q", "floors"), "q")
        mine = dealt.select("q", "run").distinct().join(asked, "q").select("q", "run", F.lit(float("inf")).alias("bound"), "dim", "ids", "matrix", "floors")
        other = dealt.join(self.rows.select("block", "dim", "ids", "matrix"), "block").select("q", "run", "bound", "dim", "ids", "matrix", none.alias("floors"))
        ordered = mine.unionByName(other).repartition("q", "run").sortWithinPartitions("q", "run", F.col("bound").desc())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, best = None, None

            def out() -> pa.RecordBatch:
                q, r, score = best.found
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key[0])), pa.array(q.astype(np.int32)), pa.array(best.ids[q]), pa.array(r), pa.array(score)], names=["q", "place", "query_id", "vec_id", "score"])

            for batch in batches:
                for k in range(batch.num_rows):
                    x = batch.slice(k, 1).to_pylist()[0]
                    ids = np.frombuffer(x["ids"], np.int64)
                    matrix = _matrix(x["matrix"], len(ids), x["dim"])
                    if (x["q"], x["run"]) == key:
                        best.add(ids, matrix)
                        continue
                    if best is not None:
                        yield out()
                    floor = np.full(len(ids), -np.inf)
                    for f in x["floors"] or []:
                        floor[f["place"]] = f["floor"]
                    key, best = (x["q"], x["run"]), Best(ids, matrix, _basis(bases, x["dim"])[0], cfg, floor)
            if best is not None:
                yield out()

        return ordered.mapInArrow(scan, "q long, place int, query_id long, vec_id long, score long")

    def result(self) -> DataFrame:
        found = self.scratch.write(self._scan(self.rest(), self.floors), "found").unionByName(self.seeds)
        order = Window.partitionBy("q", "place").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.cfg.k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, cfg: TopkConfig = TopkConfig()) -> DataFrame:
    """query_id, rank, vec_id, score for every row of ``queries`` against ``vectors`` (vec_id, embedding)."""
    return Steps(vectors, queries, cfg).result()


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
    from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e::double[], c.e::double[]) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
    where q.vec_id % 20 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""
