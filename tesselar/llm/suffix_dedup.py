"""Suffix-array dedup: removes bytes covered by long strings that also start elsewhere.

Blocks of windows that agree on a common stretch meet in classes (see ``repeats``). In a class the suffixes from the common stretch on are ordered
by a mergesort, and so are the prefixes before it, read backwards. A comparison takes prefix polynomial hashes: binary search over
the hash of a stretch gives the common extension of two suffixes in a logarithmic number of steps, and one byte decides. Common
extensions of neighbours in the two orders then say for every start which windows are equal. Every one of them is verified on
the bytes; where a hash has lied, the batch is ordered by its bytes instead.

Edge cases: a null text counts as empty; an empty text, or one shorter than the window, loses nothing; the bytes of
a cut text that no longer form whole characters go (``remove``); repeated rows are places like any others, so both lose
what they share. Extra columns are passed on by ``remove``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm.common import BY_BYTE, Scratch, table
from tesselar.llm.repeats import ROW, PrefixHash, RepeatConfig, repeated, row_hashes, same_row, with_spans

CONFIG = RepeatConfig("bytes", 400, 64)


def extension(h: PrefixHash, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common length of the stretches from a and b on, at most ``limit``: binary search over their hashes."""
    got = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(limit.max(initial=0)).bit_length() - 1)
    while step:
        fits = np.flatnonzero(got + step <= limit)
        if len(fits):
            got[fits] += step * (h(a[fits] + got[fits], step) == h(b[fits] + got[fits], step))
        step >>= 1
    return got


def suffix_order(h: PrefixHash, data: np.ndarray, place: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mergesort of suffixes of given sizes, inside stretches [start, end) of ``place``; all stretches at once.

    Every element finds its rank in the sibling run by binary search; a comparison is a common extension and one byte.
    A suffix comes before those that it begins.
    """
    order = np.arange(len(place))
    where = np.arange(len(place))
    run = 1
    while run < (end - start).max(initial=0):
        mine = (where - start) // run
        low = start + (mine ^ 1) * run
        high = np.minimum(low + run, end)
        low = np.minimum(low, high)
        first, right = low.copy(), (mine & 1) == 0
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            i, j = order[mid], order[todo]
            a, b = place[i], place[j]
            got = extension(h, a, b, np.minimum(size[i], size[j]))
            x = np.where(got < size[i], data[np.minimum(a + got, len(data) - 1)].astype(np.int64), -1)
            y = np.where(got < size[j], data[np.minimum(b + got, len(data) - 1)].astype(np.int64), -1)
            before = np.where(x == y, ~right[todo], x < y)  # equals of the left run come first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        to = start + (mine & ~1) * run + (where - start - mine * run) + (low - first)
        moved = np.empty_like(order)
        moved[to] = order
        order = moved
        run *= 2
    return order


def neighbours(h: PrefixHash, data: np.ndarray, place: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and how much each has in common with the one before it (-1 for the first of a stretch)."""
    order = suffix_order(h, data, place, size, start, end)
    view = memoryview(data)
    a, b = order[:-1], order[1:]
    inner = start[1:] == start[:-1]
    got = np.where(inner, extension(h, place[a], place[b], np.where(inner, np.minimum(size[a], size[b]), 0)), -1)
    real = np.fromiter((view[x : x + n] == view[y : y + n] for x, y, n in zip(place[a].tolist(), place[b].tolist(), np.maximum(got, 0).tolist(), strict=True)), bool, len(a))
    x = np.where(got < size[a], data[np.minimum(place[a] + got, len(data) - 1)].astype(np.int64), -1)
    y = np.where(got < size[b], data[np.minimum(place[b] + got, len(data) - 1)].astype(np.int64), -1)
    if (inner & ~(real & ((x < y) | ((x == -1) & (y == -1))))).any():  # a hash has lied: order by the bytes
        text = [bytes(view[p : p + n]) for p, n in zip(place.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(len(place)), key=lambda k: (start[k], text[k])), np.int64)
        for k, (i, j) in enumerate(zip(order[:-1].tolist(), order[1:].tolist(), strict=True)):
            both = min(len(text[i]), len(text[j]))
            differ = np.flatnonzero(np.frombuffer(text[i], np.uint8, both) != np.frombuffer(text[j], np.uint8, both))
            got[k] = -1 if start[i] != start[j] else differ[0] if len(differ) else both
    return order, np.append(-1, got)


def kernel(window: int):
    """A kernel for blocks of ``size`` windows."""

    def of_size(size: int):
        common = window - size + 1

        def run(group, data, offsets, pad, n, single):
            rows = len(group)
            count = np.bincount(group)
            end = np.cumsum(count)[group]
            start = end - count[group]
            middle = offsets[:-1] + size - 1 - pad  # where the common stretch begins
            back = np.ascontiguousarray(data[::-1])
            right, shared_right = neighbours(PrefixHash(BY_BYTE[data]), data, middle, common + pad + n - 1, start, end)
            left, shared_left = neighbours(PrefixHash(BY_BYTE[back]), back, len(data) - middle, size - 1 - pad, start, end)
            again = np.zeros((rows, size), bool)
            alike = np.empty((2, rows), np.int64)
            for j in range(size):  # the windows with j symbols after the common stretch
                alike[0, right] = np.cumsum(shared_right < common + j)
                alike[1, left] = np.cumsum(shared_left < size - 1 - j)
                live = np.flatnonzero((pad <= j) & (j < pad + n))
                key = alike[0, live] * (rows + 1) + alike[1, live]
                by = np.argsort(key)
                same = key[by][1:] == key[by][:-1]
                again[live[by[1:][same]], j] = True
                again[live[by[:-1][same]], j] = True
            again &= single[:, None]
            edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            return row, first - pad[row], last - pad[row]

        return run

    return of_size


def _kept(text: str, starts: np.ndarray, ends: np.ndarray) -> bytes:
    data = text.encode()
    if not len(starts):
        return data
    return b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))


def spans(documents: DataFrame, config: RepeatConfig = CONFIG) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text) and spans: stretches of bytes, by start, that repeated windows cover."""
    return repeated(documents, config, kernel(config.window), Scratch(documents.sparkSession))[1]


def remove(documents: DataFrame, config: RepeatConfig = CONFIG) -> DataFrame:
    """The documents with the covered bytes cut out of ``text``, and n_chars (if there) set anew."""
    docs, found = repeated(documents, config, kernel(config.window), Scratch(documents.sparkSession))
    cut = with_spans(docs, found, [T.StructField("kept", T.StringType())], lambda text, s, e: (_kept(text, s, e).decode("utf-8", "ignore") if len(s) else text,)).distinct()
    rows = documents.select(F.struct("*").alias("row"), "doc_id", *row_hashes(F.coalesce(F.col("text"), F.lit(""))))
    new = {"text": F.col("kept")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length("kept").cast(documents.schema["n_chars"].dataType)
    return rows.join(cut, same_row(rows, cut)).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = repeated(table(spark, sf_dir, "documents"), CONFIG, kernel(CONFIG.window), Scratch(spark))

    def digest(text, starts, ends):
        kept = _kept(text, starts, ends)
        return len(text.encode()), int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest()

    names = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    return with_spans(docs, found, [T.StructField(*x) for x in names.items()], digest).drop(*ROW[1:])
