"""Windows of a fixed number of symbols (bytes or words) that start at two or more places of a corpus.

How the work is kept near the size of what repeats:

1. Every window has an anchor: the gram in it with the smallest hash, the leftmost of equals. Equal windows have equal
   anchors at equal places. Neighbouring windows with one anchor form a cell; only cells (one for some dozens of
   windows) are shuffled, as digests.
2. A cell whose anchor gram comes once holds no repeated window. Cells of equal content are one entry with a count from here on: all of
   their windows repeat. Both are counts, pre-aggregated before the shuffle, whatever the size of a group.
3. What is left are cells at the borders of repeated stretches, one for each distinct content. Their windows are dealt into blocks of
   neighbouring starts. Windows of a block have a stretch in common, so only cells that agree on it can share a window of the block;
   and cells that agree on all that the block covers share all of its windows. Both are counts again. Where they differ, a class
   goes to a kernel in one task (``suffix_dedup``), or, if it holds more than ``most`` distinct stretches, its blocks are cut into smaller
   ones, which agree on more, and counted again; at one window to a block nothing is left to compare. ``substring_dedup`` takes
   this way for all classes: its levels double the agreed length.

No step gathers all cells of an anchor, and none drops any. Equality that is counted rests on 128-bit digests of the bytes (for a whole cell next
to its anchor's 64); kernels compare bytes. Rows are known by doc_id and 128 bits of hash of the text, so that a null or repeated
doc_id does no harm: two rows with one doc_id and one text are two places like any others and both lose what they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm.common import BY_BYTE, Scratch, U, by_group, hash_strings, mix, raw, slices, tune, words

BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Places in the anchors' sort key: more than an Arrow batch can hold bytes. The hash keeps the upper bits.
PLACE = (1 << 33) - 1
LOW = (1 << 64) - 1
ROW = ["doc_id", "t1", "t2"]
_powers = [np.ones(1, U), np.ones(1, U)]


@dataclass(frozen=True)
class RepeatConfig:
    unit: str  # bytes or words
    window: int
    gram: int
    #: Windows to a block, each a divisor of the one before and the last 1.
    levels: tuple[int, ...] = (64, 16, 4, 1)
    #: Distinct stretches of one class that a kernel gets in one task.
    most: int = 1024


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(n, b, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


class PrefixHash:
    """Polynomial prefix hashes of a symbol array: the hash of any stretch in constant time."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = powers(len(symbols) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(symbols * power[: len(symbols)], dtype=U)])

    def __call__(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


def cells_of(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last start (within the row), anchor's place after the first start, and anchor hash of every cell."""
    none = np.zeros(0, np.int64)
    first, last = offsets[:-1], offsets[1:] - window
    if not (last >= first).any():
        return none, none, none, none, none.astype(U)
    grams = mix(PrefixHash(values).all(gram))
    span = window - gram + 1
    key = (grams & ~U(PLACE)) | np.arange(len(grams), dtype=U)
    blocks = np.full(-(-len(key) // span) * span, ~U(0))
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    turn = np.zeros(len(values) + 1, np.int8)
    some = last >= first
    np.add.at(turn, first[some], 1)
    np.add.at(turn, last[some] + 1, -1)
    starts = np.flatnonzero(np.cumsum(turn[:-1]) > 0)
    anchor = (np.minimum(behind[starts], ahead[starts + span - 1]) & U(PLACE)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    low, high, anchor = starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]
    row = np.searchsorted(offsets, low, "right") - 1
    return row, low - offsets[row], high - offsets[row], anchor - low, grams[anchor]


@dataclass(frozen=True)
class Layout:
    """Symbols of texts one after another: by text their offsets, by symbol a 64-bit value and its place in the bytes."""

    offsets: np.ndarray
    values: np.ndarray
    data: memoryview
    starts: np.ndarray
    ends: np.ndarray

    def stretches(self, first: np.ndarray, last: np.ndarray) -> Iterator[memoryview]:
        """Bytes of symbols first up to, but without, last."""
        return (self.data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[last - 1].tolist(), strict=True))


def layout(texts: pa.Array, unit: str) -> Layout:
    """Words are laid out with one space between them, whatever stands there in the text."""
    if unit == "bytes":
        data, offsets = raw(texts)
        at = np.arange(len(data) + 1)
        return Layout(offsets, BY_BYTE[data], memoryview(data), at[:-1], at[1:])
    offsets, codes, distinct = words(texts)
    spaced = pc.binary_join_element_wise(distinct.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, at = raw(spaced.take(pa.array(codes)))
    return Layout(offsets, hash_strings(distinct)[codes], memoryview(data), at[:-1], at[1:] - 1)


def _digest(parts: Iterator[memoryview], seeds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    whole = [xxhash.xxh3_128_intdigest(x, seed) for x, seed in zip(parts, seeds.tolist(), strict=True)]
    return tuple(pa.array(np.fromiter(((x >> k) & LOW for x in whole), U, len(whole)).view(np.int64)) for k in (0, 64))


def split(df: DataFrame) -> DataFrame:
    """One row by key: joined by sorting, which can deal the many rows of a hot key to several tasks."""
    return df.hint("merge")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, the text's hashes and the text; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", *row_hashes(text), text.alias("text"))


def row_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(x, T.LongType()) for x in names]


def cells(docs: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """ROW, g (anchor's hash), c1 and c2 (content's digest) and spans (first start, length and anchor's place in one number): a text's cells of one
    content are one row, so that a text of one line again and again is no heavier than others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = layout(part.column(3), cfg.unit)
                row, low, high, anchor, g = cells_of(x.values, x.offsets, cfg.window, cfg.gram)
                c = _digest(x.stretches(x.offsets[row] + low, x.offsets[row] + high + cfg.window), np.zeros(len(row), np.int64))
                span = (low << 32) | ((high - low) << 16) | anchor
                keys = [row, g.view(np.int64), *(x.to_numpy() for x in c)]
                by = np.lexsort((span, *keys))
                keys, span = [k[by] for k in keys], span[by]
                first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[: len(span)])
                spans = pa.ListArray.from_arrays(pa.array(np.append(first, len(span)).astype(np.int32)), pa.array(span))
                take = pa.array(keys[0][first])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(3)), *(pa.array(k[first]) for k in keys[1:]), spans], names=[*ROW, "g", "c1", "c2", "spans"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *_longs("t1", "t2", "g", "c1", "c2"), T.StructField("spans", T.ArrayType(T.LongType()))]))


def bodies(docs: DataFrame, wanted: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """The wanted cells with their bytes."""
    lists = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("span", "single")).alias("cells"))
    both = docs.join(lists, same_row(docs, lists)).select(*(docs[c] for c in ROW), "text", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = layout(part.column(3), cfg.unit)
                lists = part.column(4)
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                span, single = lists.flatten().flatten()
                s = span.to_numpy()
                first = x.offsets[row] + (s >> 32)
                body = pa.array([bytes(b) for b in x.stretches(first, first + ((s >> 16) & 0xFFFF) + cfg.window)], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(3)), span, single, body], names=[*ROW, "span", "single", "body"])

    schema = T.StructType([*wanted.select(*ROW, "span", "single").schema.fields, T.StructField("body", T.BinaryType())])
    return both.mapInArrow(run, schema).withColumn("cid", F.monotonically_increasing_id())


class Blocks:
    """The blocks of ``size`` starts that cells' windows fall into, or of them those inside blocks given by number and their size."""

    def __init__(self, part: pa.RecordBatch, cfg: RepeatConfig, size: int, inside: int | None):
        column = lambda name: part.column(part.schema.get_field_index(name))
        self.part, self.cfg, self.size = part, cfg, size
        span = column("span").to_numpy()
        self.low, anchor = span >> 32, span & 0xFFFF
        # starts are counted from the anchor backwards: the same number for equal windows
        near, far, row, asks = anchor - ((span >> 16) & 0xFFFF), anchor, np.arange(len(span)), np.asarray(column("single"))
        self.key = None
        if inside is not None:
            lists = column("blocks")
            row = np.repeat(row, np.diff(lists.offsets.to_numpy()))
            fields = {f.name: x for f, x in zip(lists.type.value_type, lists.flatten().flatten(), strict=True)}
            k, asks = fields["k"].to_numpy(), np.asarray(fields["single"])
            self.key = fields["h1"].to_numpy() if "h1" in fields else None
            near, far = np.maximum(near[row], k * inside), np.minimum(far[row], k * inside + inside - 1)
        count = far // size - near // size + 1
        each = np.repeat(np.arange(len(row)), count)
        self.k = (near // size)[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        self.row, self.asks = row[each], asks[each]
        if self.key is not None:
            self.key = self.key[each]
        self.near, self.far = np.maximum(near[each], self.k * size), np.minimum(far[each], self.k * size + size - 1)
        self.anchor = anchor[self.row]
        self.pad = self.k * size + size - 1 - self.far
        self.n = self.far - self.near + 1

    def layout(self) -> tuple[Layout, np.ndarray]:
        """The cells' bytes, and by block the first symbol of its cell."""
        data, offsets = raw(self.part.column(self.part.schema.get_field_index("body")))
        if self.cfg.unit == "bytes":
            at = np.arange(len(data) + 1)
            return Layout(offsets, at, memoryview(data), at[:-1], at[1:]), offsets[self.row]
        gaps = np.flatnonzero(data == 0x20)
        starts = np.sort(np.concatenate([offsets[:-1], gaps + 1]))
        ends = np.sort(np.concatenate([offsets[1:], gaps]))
        first = np.searchsorted(starts, offsets[:-1])
        return Layout(offsets, starts, memoryview(data), starts, ends), first[self.row]


def _blocks(held: DataFrame, cfg: RepeatConfig, size: int, inside: int | None) -> DataFrame:
    """cid, k, single, and digests of what a block's windows have in common (h1, h2) and of all that they cover (u1, u2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                b = Blocks(part, cfg, size, inside)
                x, first = b.layout()
                common = first + b.anchor - b.k * size
                h = _digest(x.stretches(common, common + cfg.window - size + 1), b.k)
                u = _digest(x.stretches(first + b.anchor - b.far, first + b.anchor - b.near + cfg.window), (b.pad << 16) | b.n)
                cid = part.column(part.schema.get_field_index("cid")).take(pa.array(b.row))
                yield pa.RecordBatch.from_arrays([cid, pa.array(b.k), pa.array(b.asks), *h, *u], names=["cid", "k", "single", "h1", "h2", "u1", "u2"])

    return held.mapInArrow(run, "cid long, k long, single boolean, h1 long, h2 long, u1 long, u2 long")


#: For whole classes of blocks: group, bytes (all after one another) with their offsets, missing windows in front, number of windows,
#: and whether the block asks (others only answer). It returns blocks with the first and last of their windows that come again.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _compared(held: DataFrame, cfg: RepeatConfig, size: int, kernel: Kernel) -> DataFrame:
    """ROW and stretches (start, end) that the kernel finds in classes dealt by the digest of what they have in common."""
    row_fields = [held.schema[c] for c in ROW]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                b = Blocks(part, cfg, size, size)
                x, first = b.layout()
                body = pa.array([bytes(y) for y in x.stretches(first + b.anchor - b.far, first + b.anchor - b.near + cfg.window)], pa.binary())
                take = pa.array(b.row)
                own = [part.column(part.schema.get_field_index(c)).take(take) for c in ROW]
                yield pa.RecordBatch.from_arrays([*own, pa.array(b.key), pa.array(b.low[b.row] + b.anchor - b.far), pa.array(b.pad), pa.array(b.n), pa.array(b.asks), body], names=[*ROW, "h1", "start", "pad", "n", "single", "body"])

    schema = T.StructType([*row_fields, *_longs("h1", "start", "pad", "n"), T.StructField("single", T.BooleanType()), T.StructField("body", T.BinaryType())])

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        data, offsets = raw(t["body"].chunk(0) if t["body"].num_chunks else pa.array([], pa.binary()))
        g = t["h1"].to_numpy()
        group = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
        row, first, last = kernel(group, data, offsets, t["pad"].to_numpy(), t["n"].to_numpy(), t["single"].to_numpy())
        start = t["start"].to_numpy()[row]
        return pa.table({**{c: t[c].take(pa.array(row)) for c in ROW}, "start": pa.array(start + first), "end": pa.array(start + last + cfg.window)})

    spans = T.StructType([*row_fields, *_longs("start", "end")])
    dealt = held.mapInArrow(emit, schema).repartition("h1").sortWithinPartitions("h1")
    return dealt.mapInArrow(lambda batches: by_group(batches, "h1", one, rows=4000), spans)


def compared(held: DataFrame, cfg: RepeatConfig, kernel: Callable[[int], Kernel] | None, scratch: Scratch) -> DataFrame:
    """ROW and stretches of the asking cells' windows that come again in another cell, level by level."""
    rows, inside, parts, level = held, None, [], 0
    for level, size in enumerate(cfg.levels):
        blocks = scratch.write(_blocks(rows, cfg, size, inside), f"blocks-{level}")
        cover = blocks.groupBy("h1", "h2", "u1", "u2").agg(F.count("*").alias("m"), F.min("cid").alias("cid"), F.min("k").alias("k"), F.max("single").alias("asks"))
        cover = scratch.write(cover, f"cover-{level}")
        sure = blocks.where("single").join(split(cover.where("m > 1 and asks").select("h1", "h2", "u1", "u2")), ["h1", "h2", "u1", "u2"]).select("cid", "k")
        span, anchor = F.col("span"), F.col("span").bitwiseAND(0xFFFF)
        far = F.least(anchor, F.col("k") * size + (size - 1))
        near = F.greatest(anchor - F.shiftright(span, 16).bitwiseAND(0xFFFF), F.col("k") * size)
        start = F.shiftright(span, 32) + anchor
        parts.append(sure.join(held.select("cid", "span", *ROW), "cid").select(*ROW, (start - far).alias("start"), (start - near + cfg.window).alias("end")))
        # classes whose members differ: one block for each distinct stretch goes on
        classes = cover.groupBy("h1", "h2").agg(F.count("*").alias("d"), F.max((F.col("m") == 1) & F.col("asks")).alias("ask")).where("d > 1 and ask")
        going = cover.join(split(classes.select("h1", "h2", "d")), ["h1", "h2"]).select("cid", "d", F.struct("k", ((F.col("m") == 1) & F.col("asks")).alias("single"), "h1").alias("b"))
        going = scratch.write(going, f"going-{level}")
        listed = lambda df: held.join(df.groupBy("cid").agg(F.collect_list("b").alias("blocks")), "cid")
        if kernel is not None:
            parts.append(_compared(listed(going.where(F.col("d") <= cfg.most)), cfg, size, kernel(size)))
            going = going.where(F.col("d") > cfg.most)
        if size == 1 or going.isEmpty():
            break
        rows, inside = listed(going), size
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated(documents: DataFrame, cfg: RepeatConfig, kernel: Callable[[int], Kernel] | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and ROW with spans: an array of (start, end) stretches that repeated windows cover."""
    tune(documents.sparkSession)
    docs = keyed(documents)
    every = scratch.write(cells(docs, cfg), "cells")
    content = F.struct("c1", "c2")
    anchors = every.groupBy("g").agg(F.sum(F.size("spans")).alias("n"), F.min(content).alias("a"), F.max(content).alias("b")).where("n > 1").select("g", (F.col("a") == F.col("b")).alias("alike"))
    anchors = scratch.write(anchors, "anchors")  # as a table, so that the join below can split a hot anchor
    hit = scratch.write(every.join(split(anchors), "g"), "hit")
    scratch.drop("cells")
    low, size = F.shiftright("span", 32), F.shiftright("span", 16).bitwiseAND(0xFFFF)
    unlike = hit.where("not alike")
    contents = unlike.groupBy("g", "c1", "c2").agg(F.sum(F.size("spans")).alias("k"), F.min(F.struct(*ROW, F.col("spans")[0].alias("span"))).alias("one"))
    contents = scratch.write(contents, "contents")
    asked = contents.groupBy("g").agg(F.count("*").alias("m"), F.min("k").alias("least")).where("least = 1 and m > 1").select("g")
    asked = scratch.write(asked, "asked")
    again = unlike.join(split(contents.where("k > 1").select("g", "c1", "c2")), ["g", "c1", "c2"])
    wanted = contents.join(split(asked), "g").select(*(F.col(f"one.{c}").alias(c) for c in (*ROW, "span")), (F.col("k") == 1).alias("single"))
    held = scratch.write(bodies(docs, wanted, cfg), "bodies")
    sure = hit.where("alike").select(*ROW, "spans").unionByName(again.select(*ROW, "spans")).select(*ROW, F.explode("spans").alias("span"))
    sure = sure.select(*ROW, low.alias("start"), (low + size + cfg.window).alias("end"))
    spans = sure.unionByName(compared(held, cfg, kernel, scratch))
    return docs, spans.groupBy(*ROW).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that the given ones cover; both arrays by start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]


def with_spans(docs: DataFrame, spans: DataFrame, fields: list[T.StructField], fn: Callable[[str, np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """One row by keyed document: ROW and the fields that ``fn`` gives for its text and merged stretches."""
    both = docs.join(spans, same_row(docs, spans), "left").select(*(docs[c] for c in ROW), "text", "spans")
    kinds = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            at = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            start, end = (x.to_numpy() for x in lists.flatten().flatten())
            rows = []
            for k, text in enumerate(batch.column(3).to_pylist()):
                rows.append(fn(text, *merged(start[at[k] : at[k + 1]], end[at[k] : at[k + 1]])))
            out = [pa.array([r[j] for r in rows], kinds[f.dataType.simpleString()]) for j, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *out], names=[*ROW, *(f.name for f in fields)])

    return both.mapInArrow(run, T.StructType([docs.schema["doc_id"], *_longs("t1", "t2"), *fields]))
