"""Packing: documents as token ids, cut and packed into sequences by harmonic (reciprocal-capacity) classes.

A class k holds pieces of length floor(capacity / k), k to a sequence. A document is cut greedily at the largest class
length that fits what is left of it, down to the short lengths that are classes of their own, so every piece fills
its share of a sequence exactly. Workers number the pieces of each class on their own; a table of counts by task and class
(not by document) turns these numbers into places, so sequences are filled without moving a token. What is left at the
end of the classes, at most k - 1 pieces for each, is a number bounded by the capacity alone; first fit by
falling length packs it in one small task.

Tokens: words between ASCII white space are tokenised once by distinct word. That equals tokenising the whole text
where the tokenizer splits at white space and treats each run alone (normaliser, pre-tokeniser and model of the configured
file do); special strings in a text count as the tokenizer counts them.

Edge cases: a null or empty text is its end id alone; a null doc_id is kept as null; repeated rows are packed each; texts
of any length are cut; an empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar.llm.common import Scratch, gathered, tune, words

#: Distinct words whose ids a worker keeps; text bytes that it encodes at once.
CACHE = 700_000
STEP = 4 << 20
#: Texts that a tokenizer must give the same ids for as for their words one by one.
PROBES = ["the cat  sat\ton\n the mat.", "don't stop", " a  leading and trailing blank ", "É naïve 漢字 12,5 x_y", "one"]
_loaded: dict[str, tuple] = {}


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    capacity: int = 2048
    end_id: int = 1


def class_lengths(capacity: int) -> list[int]:
    """All values of floor(capacity / k), longest first: short lengths are all among them."""
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


def cuts(capacity: int) -> list[list[int]]:
    """By length below the capacity: the pieces it is cut into."""
    lengths = class_lengths(capacity)
    out: list[list[int]] = [[]]
    at = len(lengths) - 1
    for n in range(1, capacity):
        while at and lengths[at - 1] <= n:
            at -= 1
        out.append([lengths[at], *out[n - lengths[at]]])
    return out


class Known:
    """Ids of words met before: one flat array, and where a word's ids start in it."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, names: list[str], ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.place.update(zip(names, range(len(self.starts) - 1, len(self.starts) - 1 + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for probe in PROBES:
            apart = [x for w in probe.split() for x in tokenizer.encode(w, add_special_tokens=False).ids]
            if tokenizer.encode(probe, add_special_tokens=False).ids != apart:
                raise ValueError("the tokenizer does not treat runs between white space on their own")
        _loaded[path] = (tokenizer, Known())
    return _loaded[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text, and all ids."""
    tokenizer, known = _tokenizer(path)
    offsets, codes, distinct = words(texts)
    names = distinct.to_pylist()
    place = np.fromiter((known.place.get(x, -1) for x in names), np.int64, len(names))
    new = np.flatnonzero(place < 0)
    fresh = [names[k] for k in new]
    ids = [x.ids for x in tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
    room = max(0, CACHE - len(known.place))
    place[new[:room]] = len(known.starts) - 1 + np.arange(len(new[:room]))
    if room and fresh:
        known.add(fresh[:room], ids[:room])
    once = Known()  # words beyond the cache
    once.add(fresh[room:], ids[room:])
    place[new[room:]] = len(known.starts) - 1 + np.arange(len(new[room:]))
    every = np.concatenate([known.starts[:-1], len(known.flat) + once.starts])
    start, size = every[place], every[place + 1] - every[place]
    own = np.concatenate([[0], np.cumsum(size)])  # this step's words one after another: a small array to gather from
    flat = np.concatenate([known.flat, once.flat])[np.arange(own[-1]) + np.repeat(start - own[:-1], size)]
    by_word = size[codes]
    total = np.concatenate([[0], np.cumsum(by_word)])
    where = np.arange(total[-1]) + np.repeat(own[:-1][codes] - total[:-1], by_word)
    return total[offsets], flat[where]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


def pieces(documents: DataFrame, config: PackConfig) -> DataFrame:
    """The cut documents: one row by piece, numbered (``place``) by task and length."""
    tune(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, table, cap = TaskContext.get().partitionId(), cuts(config.capacity), config.capacity
        seen = [0] * (cap + 1)
        for part in gathered(batches, STEP):
            at, ids = encode(part.column(1), config.tokenizer)
            doc, start, length, crc, tokens, place = [], [], [], [], [], []
            for row, name in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[at[row] : at[row + 1]], np.uint32(config.end_id)).astype("<u4")
                view, n, s = memoryview(own.tobytes()), len(own), 0
                for size in [cap] * (n // cap) + table[n % cap]:
                    doc.append(name)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(view[4 * s : 4 * (s + size)]))
                    tokens.append(n)
                    place.append(seen[size])
                    seen[size] += 1
                    s += size
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, tokens)] + [pa.array([task] * len(doc), pa.int32()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"])

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(documents: DataFrame, config: PackConfig) -> DataFrame:
    """One row by piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(documents.sparkSession)
    cap = config.capacity
    rows = scratch.write(pieces(documents, config), "pieces")
    by_task = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    full = F.floor(F.col("total") / F.col("fits")).cast("long")
    classes = rows.groupBy("length").agg(F.count("*").alias("total")).withColumn("fits", F.floor(F.lit(cap) / F.col("length")).cast("long")).withColumn("full", full)
    # one row by class: a hundred at most for a capacity of 2048
    earlier = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("base", F.coalesce(F.sum("full").over(earlier), F.lit(0))).withColumn("bins", F.sum("full").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    table = scratch.write(by_task.join(F.broadcast(classes), "length").drop("n", "total"), "classes")
    placed = rows.join(table, ["length", "task"]).withColumn("rank", F.col("first") + F.col("place"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = placed.where(F.col("rank") < F.col("full") * F.col("fits")).select(
        *columns,
        (F.col("base") + F.floor(F.col("rank") / F.col("fits")).cast("long")).alias("sequence_id"),
        ((F.col("rank") % F.col("fits")) * F.col("length")).alias("offset"),
    )
    rest = placed.where(F.col("rank") >= F.col("full") * F.col("fits")).select(*columns, "bins", "rank")

    def first_fit(key, pdf):
        pdf = pdf.sort_values(["length", "rank"], ascending=[False, True], kind="stable")
        room: list[int] = []
        bins, at, open_from = [], [], {}
        for n in pdf["length"]:
            k = open_from.get(n, 0)
            while k < len(room) and room[k] < n:
                k += 1
            open_from[n] = k
            if k == len(room):
                room.append(cap)
            bins.append(k)
            at.append(cap - room[k])
            room[k] -= n
        return pdf.assign(sequence_id=pdf["bins"] + bins, offset=at)[[*columns, "sequence_id", "offset"]]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return filled.unionByName(rest.groupBy(F.lit(0).alias("all")).applyInPandas(first_fit, schema))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesselar.llm.common import table

    return pack(table(spark, sf_dir, "documents"), PackConfig(public_tokenizers.path("word_bpe_49k.json")))
