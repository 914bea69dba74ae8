"""Exact n-gram Jaccard join: pivots, Voronoi regions, triangle-inequality windows, joined recursively.

A text's set holds the hashes (54 bits) of its distinct word n-grams; Jaccard distance on sets is a metric. Equal sets
form a class, and classes are the points that are joined.

1. Cells of a partitioned universe. With similarity t, two sets of at most M elements differ in at most
   D = floor(2 M (1 - t) / (1 + t)) elements, so of B parts of the universe at least B - D hold the same elements of both. With B a
   half more than D, each class sends one key for each part that is not empty, and is dropped as having no partner when fewer of its
   keys are shared than any partner must share (B - D less its empty parts); dropping goes on for some rounds. A class whose
   empty parts could be all that it shares sends those too, and is never dropped while it shares a key: a partner may send no
   empty parts. Sizes are dealt into ranges, and a set that can reach the next range is replicated to it: the triangle
   inequality with the empty set as pivot.
2. Keys that two or more classes share tie them to one point; components of these ties are the first regions.
   No pair is formed here: a key with m classes gives m ties.
3. A region of any size is joined recursively: pivots are drawn from it and compared with all of it, each other class is at home with
   its nearest pivot, and goes as a copy to every other pivot that is at most 2 (1 - t) farther. Any linked pair then meets where
   either is at home. Regions too large for a task are split so by Spark jobs, others within a task. Where pivots do not part what is
   left, the windows alone decide: classes meet whose distances to every pivot differ by at most 1 - t. Of these, parity
   sketches (a lower bound on the difference) skip some, and the rest is compared exactly. Pairs already connected are skipped.
   A large region that pivots cannot split is joined by blocks, each pair of blocks a region of its own: nothing is left out.

Edge cases: a text with fewer words than n, but some, has its whole sequence as one element; a null or empty text, or one
of white space only, has an empty set and links with nothing; equal non-empty sets are linked. Rows with a null doc_id take no
part (component_id null); rows that share a doc_id are one point of the link graph. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar.llm.common import Scratch, U, by_group, components, hash_strings, mix, slices, table, tune, words

ELEMENT = U((1 << 54) - 1)
STEPS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
SKETCH = 1024
SALTS = 16


@dataclass(frozen=True)
class JoinConfig:
    n: int = 3
    #: Linked when over * intersection >= under * union.
    over: int = 100
    under: int = 90
    lower: bool = True
    #: Classes and elements that one task joins at once.
    most: int = 6000
    elements: int = 3_000_000
    pivots: int = 12
    #: Parts of the universe beyond the largest difference, as a share of it; and rounds of dropping.
    slack: float = 0.5
    rounds: int = 3

    @property
    def radius(self) -> float:
        return 1 - self.under / self.over


def shingles(texts: pa.Array, cfg: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and the sorted distinct elements of its set. At most 1,000 texts at once."""
    offsets, codes, distinct = words(texts, cfg.lower)
    value = hash_strings(distinct)[codes]
    size = np.diff(offsets)
    total = np.zeros(len(value), U)
    for k in range(cfg.n):  # the last places of a text run out of words; only a short text's first place counts then
        whole = max(0, len(value) - k)  # a run of texts can hold fewer words than n
        total[:whole] += value[k : k + whole] * STEPS[k]
    count = np.where(size >= cfg.n, size - cfg.n + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    place = np.repeat(offsets[:-1] - np.cumsum(count) + count, count) + np.arange(len(row))
    element = total[place]
    for r in np.flatnonzero((size > 0) & (size < cfg.n)):
        own = value[offsets[r] : offsets[r + 1]]
        element[np.searchsorted(row, r)] = (own * np.array(STEPS[: len(own)])).sum(dtype=U) + U(len(own))
    key = np.sort((row.astype(U) << U(54)) | (mix(element) & ELEMENT))
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    at = np.searchsorted(key, np.arange(len(size) + 1, dtype=U) << U(54))
    return at, key & ELEMENT


def ranges(limit: int) -> list[int]:
    """First sizes of the size ranges: each a half longer than the one before."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return edges


def keys(at: np.ndarray, elements: np.ndarray, cfg: JoinConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and how many keys any partner shares, for a text's own range and the next one if it can reach it."""
    size = np.diff(at)
    edges = np.array(ranges(int(size.max(initial=1)) * 2 + 2))
    own = np.searchsorted(edges, size, "right") - 1
    rows, out, needs = [], [], []
    for up in (0, 1):
        live = np.flatnonzero((size > 0) & ((size * cfg.over // cfg.under >= edges[np.minimum(own + 1, len(edges) - 1)]) if up else True))
        if not len(live):
            continue
        which = own[live] + up
        most = 2 * (edges[which + 1] - 1) * (cfg.over - cfg.under) // (cfg.over + cfg.under)
        parts = most + np.maximum(2, (cfg.slack * most).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(parts)])
        n = size[live]
        inner = np.repeat(np.arange(len(live)), n)
        e = elements[np.repeat(at[live] - np.cumsum(n) + n, n) + np.arange(len(inner))]
        slot = first[inner] + ((mix(e ^ U(0x5851F42D4C957F2D)) >> U(20)) % parts[inner].astype(U)).astype(np.int64)
        total = np.zeros(first[-1], U)
        np.add.at(total, slot, mix(e + STEPS[0]))
        filled = np.bincount(slot, minlength=first[-1]) > 0
        row = np.repeat(np.arange(len(live)), parts)
        part = np.arange(len(row)) - first[row]
        # a partner of a set of n elements has n / t at most, so they differ in at most n (1 - t) / t
        least = parts - np.minimum(most, n * (cfg.over - cfg.under) // cfg.under)
        bare = least - np.bincount(row[~filled], minlength=len(live))
        keep = filled | (bare < 1)[row]
        # a partner that sends no empty parts shares filled ones alone: where those could be none, any shared key is enough
        need = np.maximum(bare, 1)
        salt = (which[row].astype(U) << U(32)) + part.astype(U)
        rows.append(live[row[keep]])
        out.append(mix(total[keep] + mix(salt[keep] + STEPS[1])))
        needs.append(need[row[keep]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    row = np.concatenate(rows)
    by = np.argsort(row, kind="stable")
    return row[by], np.concatenate(out)[by], np.concatenate(needs)[by]


def _digests(at: np.ndarray, elements: np.ndarray) -> np.ndarray:
    view = memoryview(elements.view(np.uint8)) if len(elements) else memoryview(b"")
    return np.fromiter((xxhash.xxh3_64_intdigest(view[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), U, len(at) - 1).view(np.int64)


def sets(documents: DataFrame, cfg: JoinConfig) -> DataFrame:
    """doc_id, n_shingles and point (hash of the set; null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, elements = shingles(part.column(1), cfg)
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(_digests(at, elements), mask=size == 0)], names=["doc_id", "n_shingles", "point"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, point long")


def sent(documents: DataFrame, cfg: JoinConfig) -> DataFrame:
    """point, key, need: one row by key. Copies in one batch send theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, elements = shingles(part.column(0), cfg)
                point = _digests(at, elements)
                row, key, need = keys(at, elements, cfg)
                once = np.zeros(len(point), bool)
                once[np.unique(point, return_index=True)[1]] = True
                row, key, need = row[once[row]], key[once[row]], need[once[row]]
                yield pa.RecordBatch.from_arrays([pa.array(point[row]), pa.array(key.view(np.int64)), pa.array(need.astype(np.int32))], names=["point", "key", "need"])

    return documents.where("doc_id is not null").select("text").mapInArrow(run, "point long, key long, need int")


def shared_keys(documents: DataFrame, cfg: JoinConfig, scratch: Scratch) -> DataFrame:
    """Keys that two or more classes share, of classes that share as many as any partner must: one shuffle of all keys."""
    by_key = Window.partitionBy("key")
    two = lambda df: df.withColumns({"one": F.min("point").over(by_key), "two": F.max("point").over(by_key)}).where("one <> two")
    live = scratch.write(two(sent(documents, cfg)).select("point", "key", "need").distinct(), "shared-0")
    for k in range(cfg.rounds):
        enough = live.groupBy("point", "need").agg(F.count("*").alias("n")).where("n >= need").select("point", "need")
        live = scratch.write(two(live.join(enough, ["point", "need"])).select("point", "key", "need"), f"shared-{k + 1}")
        scratch.drop(f"shared-{k}")
    return live


def members(documents: DataFrame, wanted: DataFrame, cfg: JoinConfig) -> DataFrame:
    """region, point and elements of the wanted points: one text for each, read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, elements = shingles(part.column(0), cfg)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(elements.view(np.int64)))
                mine = pa.array(_digests(at, elements) == part.column(1).to_numpy())
                out = pa.RecordBatch.from_arrays([part.column(2), part.column(1), lists], names=["region", "point", "elements"])
                yield out.filter(mine)

    both = documents.select("doc_id", "text").join(wanted, "doc_id").select("text", "point", "region")
    return both.mapInArrow(run, "region long, point long, elements array<long>")


# ---- joining one region in a task -------------------------------------------------------------


class Region:
    """Sets of a region as one array, joined recursively. ``label`` joins up what is linked."""

    def __init__(self, at: np.ndarray, elements: np.ndarray, home: np.ndarray, cfg: JoinConfig):
        self.at, self.elements, self.home, self.cfg = at, elements, home, cfg
        self.size = np.diff(at)
        self.label = np.arange(len(self.size))
        self.sketch: np.ndarray | None = None
        self.rng = np.random.default_rng(1)
        self.measured = 0

    def set(self, k: int) -> np.ndarray:
        return self.elements[self.at[k] : self.at[k + 1]]

    def shared(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Size of the intersection with one set, by row."""
        p = self.set(pivot)
        n = self.size[rows]
        take = np.repeat(self.at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        e = self.elements[take]
        hit = p[np.minimum(np.searchsorted(p, e), len(p) - 1)] == e
        return np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        return self.cfg.over * shared >= self.cfg.under * (self.size[a] + self.size[b] - shared)

    def tie(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)

    def join(self, rows: np.ndarray, home: np.ndarray) -> None:
        """Pivots are compared with all; the others go on in the pivots' regions, or where these do not part them, by windows alone."""
        if len(rows) < 2 or not home.any() or (self.label[rows] == self.label[rows[0]]).all():
            return
        chosen = np.zeros(len(rows), bool)
        chosen[self.rng.choice(len(rows), min(self.cfg.pivots, max(1, len(rows) // 4)), replace=False)] = True
        pivots, rows, home = rows[chosen], rows[~chosen], home[~chosen]
        away = np.empty((len(rows), len(pivots)))
        for k, p in enumerate(pivots):
            others = np.concatenate([rows, pivots[k + 1 :]])
            if not len(others):
                continue
            got = self.shared(p, others)
            self.measured += len(others)
            away[:, k] = 1 - got[: len(rows)] / (self.size[rows] + self.size[p] - got[: len(rows)])
            for r in others[self.linked(got, others, p) & (self.label[others] != self.label[p])]:
                self.tie(r, p)
        near = away.argmin(axis=1)
        copy = away <= away.min(axis=1)[:, None] + 2 * self.cfg.radius + 1e-9
        if (copy.sum(axis=0).astype(float) ** 2).sum() > 0.6 * len(rows) ** 2:
            self.pairs(rows, home, away)
            return
        for k in range(len(pivots)):
            mine = copy[:, k]
            self.join(rows[mine], home[mine] & (near[mine] == k))

    def sketches(self) -> np.ndarray:
        if self.sketch is None:
            row = np.repeat(np.arange(len(self.size)), self.size)
            bits = np.zeros(len(self.size) * SKETCH, np.uint8)
            place = row * SKETCH + (self.elements & U(SKETCH - 1)).astype(np.int64)
            np.bitwise_xor.at(bits, place, np.uint8(1))
            self.sketch = np.packbits(bits).view(U).reshape(len(self.size), -1)
        return self.sketch

    def pairs(self, rows: np.ndarray, home: np.ndarray, away: np.ndarray) -> None:
        """Those meet whose distances to every pivot differ by no more than a linked pair's can, and whose sizes allow it."""
        by = np.argsort(self.size[rows], kind="stable")
        rows, home, away = rows[by], home[by], away[by]
        n = self.size[rows]
        ends = np.searchsorted(n, n * self.cfg.over // self.cfg.under, "right")
        for i in range(len(rows)):
            other = np.arange(i + 1, ends[i])
            if not home[i]:
                other = other[home[other]]
            other = other[self.label[rows[other]] != self.label[rows[i]]]
            other = other[(np.abs(away[other] - away[i]) <= self.cfg.radius + 1e-9).all(axis=1)]
            if len(other) > 4:
                s = self.sketches()
                differ = np.bitwise_count(s[rows[other]] ^ s[rows[i]]).sum(axis=1, dtype=np.int64)
                # a linked pair differs in at most (over - under) / (over + under) of its elements
                other = other[differ * (self.cfg.over + self.cfg.under) <= (n[i] + n[other]) * (self.cfg.over - self.cfg.under)]
            for j in other:
                a, b = rows[i], rows[j]
                if self.label[a] != self.label[b]:
                    self.measured += 1
                    got = len(np.intersect1d(self.set(a), self.set(b), assume_unique=True))
                    if self.cfg.over * got >= self.cfg.under * (n[i] + n[j] - got):
                        self.tie(a, b)


def joined(regions: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Ties (a, b) that connect what is linked in each region: at most one for each of its points."""

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = t["elements"].chunk(0)
        elements = np.ascontiguousarray(lists.flatten().to_numpy()).view(U)
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        region, point, home = t["region"].to_numpy(), t["point"].to_numpy(), t["home"].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
        a, b = [], []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if e - s > 1:
                r = Region(at[s : e + 1] - at[s], elements[at[s] : at[e]], home[s:e], cfg)
                r.join(np.arange(e - s), home[s:e])
                own = np.flatnonzero(r.label != np.arange(e - s))
                a.append(point[s:e][own])
                b.append(point[s:e][r.label[own]])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_group(batches, "region", one, rows=200)

    return regions.select("region", "point", "home", "elements").repartition("region").sortWithinPartitions("region", "point").mapInArrow(run, "a long, b long")


# ---- the whole join ---------------------------------------------------------------------------


def distances(large: DataFrame, cfg: JoinConfig, level: int) -> DataFrame:
    """region, point, home and the distances to the region's pivots. Points of a region are dealt by salt, its few pivots copied to each."""
    first = Window.partitionBy("region").orderBy(F.xxhash64("point", F.lit(level)), "point")
    names = large.select("region", "point").withColumn("r", F.row_number().over(first)).where(F.col("r") <= cfg.pivots)
    chosen = large.join(names, ["region", "point"]).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("r", "elements"))).alias("pivots"))
    chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = F.size("elements")

    def away(p):
        got = F.size(F.array_intersect("elements", p["elements"]))
        return 1 - got / (mine + F.size(p["elements"]) - got)

    salted = large.withColumn("salt", F.pmod(F.xxhash64("point", F.lit("salt")), F.lit(SALTS)).cast("int"))
    return salted.join(chosen, ["region", "salt"]).select("region", "point", "home", F.transform("pivots", away).alias("away"))


def dealt(away: DataFrame, cfg: JoinConfig, level: int) -> DataFrame:
    """The Voronoi regions that a point goes to: at home with the nearest pivot, as a copy where the window reaches."""
    near = away.withColumn("near", F.array_position("away", F.array_min("away")) - 1)
    spread = near.select("region", "point", "home", "near", F.array_min("away").alias("least"), F.posexplode("away").alias("k", "d")).where(F.col("d") <= F.col("least") + 2 * cfg.radius + 1e-9)
    return spread.select(F.col("region").alias("parent"), "point", F.xxhash64("region", "k", F.lit(level)).alias("region"), (F.col("home") & (F.col("k") == F.col("near"))).alias("home"))


def blocks(large: DataFrame, sizes: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Regions that pivots do not split: every pair of blocks of their points is a region. Block numbers grow with the region alone."""
    n = F.greatest(F.ceil(2 * F.col("m") / cfg.most), F.ceil(2 * F.col("e") / cfg.elements)).cast("int")
    rows = large.join(sizes.withColumn("n", n).select("region", "n"), "region").withColumn("own", F.pmod(F.xxhash64("point", F.lit("block")), F.col("n")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return rows.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"), F.lit("pair")).alias("region"), "point", "elements", "home")


def similar(documents: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    tune(documents.sparkSession)
    scratch = Scratch(documents.sparkSession)
    rows = scratch.write(sets(documents, cfg), "sets")
    known = rows.where("point is not null and doc_id is not null")
    live = shared_keys(documents, cfg, scratch)
    ones = live.groupBy("key").agg(F.min("point").alias("one"))
    ties = live.join(ones, "key").where("point <> one").select(F.col("point").alias("a"), F.col("one").alias("b")).distinct()
    first = scratch.write(components(ties, scratch, "tied"), "first")
    text_of = known.groupBy("point").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.join(text_of, first["id"] == text_of["point"]).select("doc_id", "point", F.col("component_id").alias("region"))
    regions = scratch.write(members(documents, wanted, cfg).dropDuplicates(["point"]).withColumn("home", F.lit(True)), "regions-0")
    links = None
    level = 0
    while True:
        sizes = regions.groupBy("region").agg(F.count("*").alias("m"), F.sum(F.size("elements").cast("long")).alias("e"))
        large = sizes.where((F.col("m") > cfg.most) | (F.col("e") > cfg.elements))
        large = scratch.write(large, f"large-{level}")
        got = joined(regions.join(large.select("region"), "region", "left_anti"), cfg)
        links = got if links is None else links.unionByName(got)
        if large.isEmpty():
            break
        big = regions.join(large.select("region"), "region", "left_semi")
        level += 1
        # distances first, without the sets: only a split that pays moves them
        placed = dealt(scratch.write(distances(big, cfg, level), f"away-{level}"), cfg, level)
        work = placed.groupBy("parent", "region").agg(F.count("*").alias("m"), F.max(F.col("home").cast("int")).alias("any")).where("any = 1")
        live = work.select("parent", "region")
        work = work.groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
        pays = scratch.write(large.join(work, large["region"] == work["parent"]).where("work <= 0.6 * m * m").select("parent"), f"pays-{level}")
        stuck = large.join(pays, large["region"] == pays["parent"], "left_anti")
        links = links.unionByName(joined(blocks(big, stuck, cfg), cfg))
        # a part where no point is at home joins nothing
        parts = placed.join(pays, "parent", "left_semi").join(live, ["parent", "region"], "left_semi")
        sets_of = big.select(F.col("region").alias("parent"), "point", "elements")
        regions = scratch.write(parts.join(sets_of, ["parent", "point"]).select("region", "point", "elements", "home"), f"regions-{level}")
    linked = components(links, scratch, "linked").withColumnRenamed("id", "point")
    named = known.select("point", "doc_id").join(linked, "point", "left").select("doc_id", F.coalesce("component_id", "point").alias("c"))
    # rows that share a doc_id join their sets' components
    shared_ids = named.groupBy("doc_id").agg(F.min("c").alias("b"), F.max("c").alias("a")).where("a <> b")
    more = named.join(shared_ids.select("doc_id", "b"), "doc_id").select(F.col("c").alias("a"), "b")
    over = components(more, scratch, "named").withColumnRenamed("id", "c").withColumnRenamed("component_id", "to")
    points = linked.select("point", F.col("component_id").alias("c"))
    whole = rows.join(points, "point", "left").withColumn("c", F.coalesce("c", "point")).join(over, "c", "left").withColumn("c", F.coalesce("to", "c"))
    whole = scratch.write(whole.select("doc_id", "n_shingles", "c"), "whole")
    least = scratch.write(whole.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low")), "least")
    out = whole.join(least.hint("merge"), "c", "left")  # by sorting: the rows of a large component can be dealt to several tasks
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, cfg: JoinConfig) -> DataFrame:
    """The documents with one row of each linked group: that of the smallest doc_id. Rows with a null doc_id stay."""
    found = similar(documents, cfg).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti").select(*documents.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
