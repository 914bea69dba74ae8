"""SentencePiece encoding and decoding by suffix-array matching.

A batch's new words are laid out one after another and their suffixes sorted; a binary search for every piece of the
vocabulary gives the range of its occurrences. These are the edges, (place, length) to piece, sorted by place. The edges are then
relaxed in the order that a merge vocabulary prescribes: in every word at once, the two neighbours whose joint edge has
the best score are joined, the leftmost of equals, until no word has one; a long word keeps its joints in a queue, so that its
time grows with length times its logarithm. (A shortest path by score would not give the
ids of a merge model; the joins do.) Characters without a piece fall back to bytes.

No piece has the word mark after another character or holds a line end, so words that begin with their marks, and line ends,
are encoded on their own, once by distinct word; the loader checks that this is so.

Edge cases: a null or empty text has no ids and decodes to an empty one; runs of spaces, leading and trailing ones
and every other character come back as they were, whatever the length; repeated rows are encoded each. Extra columns pass; one
that clashes with an output column is replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tesselar.llm.common import U, slices, table, tune
from tesselar.llm.packing import Known

MARK = "▁"
CACHE = 400_000
#: Bytes of new words that are indexed at once.
INDEXED = 1 << 20
#: Symbols of a word from which on its joins come out of a queue instead of rounds over all words.
LONG = 128
PIECE_BITS = 20
_loaded: dict = {}


@dataclass
class Vocabulary:
    """Pieces as sorted byte strings of ``columns`` words of eight bytes, with ids and ranks; and the bytes of every id."""

    columns: int
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    rank: np.ndarray
    byte_ids: np.ndarray
    text_of: list[bytes]


def load(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(k) for k in range(n)]
    plain = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    if any(MARK in names[k].lstrip(MARK) or "\n" in names[k] for k in plain):
        raise ValueError("a piece has the word mark after another character, or a line end")
    data = [names[k].encode() for k in plain]
    if max(map(len, data)) > 63 or len(data) >= 1 << PIECE_BITS:
        raise ValueError("pieces of 64 bytes and more, or a million of them, do not fit the edge keys")
    columns = -(-max(map(len, data)) // 8)
    packed = lambda fill: np.frombuffer(b"".join(x.ljust(8 * columns, fill) for x in data), ">u8").astype(U).reshape(-1, columns)
    score = np.array([sp.get_score(k) for k in plain])
    text_of = [b"" if sp.is_control(k) or sp.is_unknown(k) else bytes([int(names[k][3:5], 16)]) if sp.is_byte(k) else names[k].replace(MARK, " ").encode() for k in range(n)]
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
    return Vocabulary(columns, packed(b"\0"), packed(b"\xff"), np.array(list(map(len, data))), np.array(plain, np.uint32), np.unique(-score, return_inverse=True)[1].astype(np.int64), byte_ids, text_of)


def occurrences(data: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Edges sorted by place: place * 64 + length, and the index of the piece.

    Suffixes are ordered by their first eight bytes. Only those that begin like a longer piece are ordered further.
    """
    padded = np.concatenate([data, np.zeros(8 * v.columns, np.uint8)])
    word = np.zeros(len(padded) - 7, U)
    for k in range(8):
        word = (word << U(8)) | padded[k : len(padded) - 7 + k].astype(U)
    order = np.argsort(word[: len(data)])
    ordered = word[order]
    found: list[np.ndarray] = []

    def emit(pieces: np.ndarray, suffixes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        count = np.maximum(stop - start, 0)
        piece = np.repeat(pieces, count)
        at = suffixes[np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(piece))]
        found.append(((at * 64 + v.size[piece]) << PIECE_BITS) | piece)

    short = np.flatnonzero(v.size <= 8)
    emit(short, order, np.searchsorted(ordered, v.low[short, 0], "left"), np.searchsorted(ordered, v.high[short, 0], "right"))
    pieces = np.flatnonzero(v.size > 8)
    if len(pieces):
        heads = np.unique(v.low[pieces, 0])
        low, high = np.searchsorted(ordered, heads, "left"), np.searchsorted(ordered, heads, "right")
        group = np.repeat(np.arange(len(heads)), high - low)
        own = order[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(group))]
        of_piece = np.searchsorted(heads, v.low[pieces, 0])
        for c in range(1, v.columns):
            if not len(pieces) or not len(own):
                break
            key = word[own + 8 * c]
            by = np.lexsort((key, group))
            own, group, key = own[by], group[by], key[by]
            equal_from = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
            first, last = np.searchsorted(group, of_piece, "left"), np.searchsorted(group, of_piece, "right")
            start, stop = _within(key, first, last, v.low[pieces, c], False), _within(key, first, last, v.high[pieces, c], True)
            ends = v.size[pieces] <= 8 * (c + 1)
            emit(pieces[ends], own, start[ends], stop[ends])
            some = ~ends & (stop > start)
            pieces, start, stop = pieces[some], start[some], stop[some]
            group = np.searchsorted(equal_from, np.arange(len(own)), "right")
            of_piece = np.searchsorted(equal_from, start, "right")
            keep = np.isin(group, of_piece)
            own, group = own[keep], group[keep]
    key = np.sort(np.concatenate(found))
    return key >> PIECE_BITS, key & ((1 << PIECE_BITS) - 1)


def _within(key: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every bound in its own sorted stretch [low, high) of ``key``."""
    low, high = low.copy(), high.copy()
    while (go := low < high).any():
        mid = (low + high) // 2
        value = key[np.minimum(mid, len(key) - 1)]
        less = (value <= bound) if after else (value < bound)
        low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
    return low


def _relax_long(at: np.ndarray, size: np.ndarray, edge: np.ndarray, piece: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same joins for one long word: a queue of joint edges, best score first, leftmost of equals."""
    keys, pieces, rank = array("q", edge.tobytes()), array("q", piece.tobytes()), v.rank.tolist()
    n = len(at)
    place, length = at.tolist(), size.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def joint(left: int) -> None:
        right = after[left]
        if right < n and (long := length[left] + length[right]) < 64:
            k = bisect_left(keys, key := place[left] * 64 + long)
            if k < len(keys) and keys[k] == key:
                heappush(queue, (rank[pieces[k]], left, long))

    queue: list[tuple[int, int, int]] = []
    for k in range(n - 1):
        joint(k)
    while queue:
        _, left, long = heappop(queue)
        right = after[left]
        if length[left] and right < n and length[left] + length[right] == long:
            length[left], length[right] = long, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            joint(left)
            if before[left] >= 0:
                joint(before[left])
    live = np.flatnonzero(length)
    return at[live], np.array(length)[live]


def match(new: list[str], v: Vocabulary) -> list[np.ndarray]:
    """The ids of every word."""
    raw = [w.encode() for w in new]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)  # a zero byte is in no piece
    edge, piece = occurrences(data, v)
    lead = ((data & 0xC0) != 0x80) & (data != 0)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))) - 1
    for k in np.flatnonzero(np.array([b"\0" in x for x in raw], bool)):  # a zero character is a symbol of its own
        lead[ends[k] - len(raw[k]) : ends[k]] = (data[ends[k] - len(raw[k]) : ends[k]] & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    row = np.searchsorted(ends, at)
    size = np.where(np.append(row[1:] == row[:-1], False), np.append(at[1:], 0) - at, ends[row] - at)

    def find(place: np.ndarray, length: np.ndarray) -> np.ndarray:
        key = place * 64 + length
        k = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
        return np.where((edge[k] == key) & (length < 64), piece[k], -1) if len(edge) else np.full(len(place), -1)

    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    symbols = np.bincount(row, minlength=len(new))
    for k in np.flatnonzero(symbols > LONG):
        own = slice(*np.searchsorted(row, [k, k + 1]))
        lo, hi = np.searchsorted(edge, [64 * at[own.start], 64 * (ends[k] + 1)])
        a, z = _relax_long(at[own], size[own], edge[lo:hi], piece[lo:hi], v)
        done.append((np.full(len(a), k), a, z))
    rest = symbols[row] <= LONG
    at, row, size = at[rest], row[rest], size[rest]
    worst = np.int64(1) << np.int64(62)

    def costs(k: np.ndarray) -> np.ndarray:
        """Of joining symbols k and k + 1, which are of one word."""
        got = find(at[k], size[k] + size[k + 1])
        return np.where(got >= 0, v.rank[got], worst)

    cost = np.full(len(at), worst)
    two = np.flatnonzero(row[1:] == row[:-1])
    cost[two] = costs(two)
    while len(at):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        count = np.diff(np.append(first, len(at)))
        low = np.repeat(np.minimum.reduceat(cost, first), count)
        still = low < worst
        if not still.all():
            done.append((row[~still], at[~still], size[~still]))
        hit = np.flatnonzero((cost == low) & still)
        if not len(hit):
            break
        hit = hit[np.append(True, row[hit[1:]] != row[hit[:-1]])]  # the leftmost of equals
        size[hit] += size[hit + 1]
        still[hit + 1] = False
        moved = np.cumsum(still) - 1
        at, row, size, cost, hit = at[still], row[still], size[still], cost[still], moved[hit]
        cost[hit] = worst  # only joints with what was just joined have changed
        touched = np.concatenate([hit, hit - 1])
        touched = touched[(touched >= 0) & (touched + 1 < len(row))]
        touched = touched[row[touched] == row[touched + 1]]
        cost[touched] = costs(touched)
    row, at, size = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
    by = np.argsort(at, kind="stable")
    row, at, size = row[by], at[by], size[by]
    got = find(at, size)
    width = np.where(got >= 0, 1, size)
    where = np.concatenate([[0], np.cumsum(width)])
    ids = np.zeros(where[-1], np.uint32)
    ids[where[:-1][got >= 0]] = v.ids[got[got >= 0]]
    lost = np.flatnonzero(got < 0)
    inner = np.repeat(where[lost] - np.cumsum(size[lost]) + size[lost], size[lost]) + np.arange(size[lost].sum())
    ids[inner] = v.byte_ids[data[np.repeat(at[lost] - np.cumsum(size[lost]) + size[lost], size[lost]) + np.arange(size[lost].sum())]]
    cut = where[np.searchsorted(row, np.arange(len(new) + 1))]
    return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of every text."""
    if path not in _loaded:
        _loaded[path] = (load(path), Known())
    v, known = _loaded[path]
    split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    new = sorted({w for s in split for w in s if w not in known.place})
    ids, held = [], 0
    group: list[str] = []
    for w in [*new, None]:
        if group and (w is None or held > INDEXED):
            ids += match(group, v)
            group, held = [], 0
        if w is not None:
            group.append(w)
            held += len(w)
    if len(known.place) + len(new) > CACHE:
        known.place.clear()
        known.starts, known.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        _loaded[path] = (v, known := Known())
        missing = sorted({w for s in split for w in s} - set(new))
        ids += match(missing, v) if missing else []
        new = new + missing
    known.add(new, ids)
    out = []
    for s in split:
        place = np.fromiter(map(known.place.__getitem__, s), np.int64, len(s))
        size = np.diff(known.starts)[place] if len(s) else np.zeros(0, np.int64)
        total = np.cumsum(size)
        out.append(known.flat[np.repeat(known.starts[place] - total + size, size) + np.arange(total[-1])] if len(s) else np.zeros(0, np.uint32))
    return out


def decode(ids: np.ndarray, path: str) -> str:
    """The text: pieces and bytes joined, the mark put in front of it taken off."""
    v = _loaded[path][0] if path in _loaded else load(path)
    return b"".join(map(v.text_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """The documents with ``ids``, an array of piece ids."""
    tune(documents.sparkSession)
    documents = documents.drop("ids")
    schema = T.StructType([*documents.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                ids = encode([x or "" for x in part.column(part.schema.get_field_index("text")).to_pylist()], path)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.names)

    return documents.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``."""
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            at, flat = lists.offsets.to_numpy(), np.asarray(lists.values)
            texts = [decode(flat[a:b], path) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = encode(texts, path)
                same = [decode(x, path) == t for x, t in zip(ids, texts, strict=True)]
                crc = [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
