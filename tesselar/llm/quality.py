"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct hashed words, weighted by how often they come (scaled to length 1 over the text),
and one bucket for every structure statistic and for the declared length n_chars. The pairwise part is worked out in
linear time: half of (sum of v x) squared minus the sum of (v x) squared, by factor.

The columns lang, source, doc_id and labels are never inputs of a score; the metadata is n_chars alone (a bucket of its
own when null or absent).

Edge cases: a null text counts as empty; an empty text is scored by its structure buckets. Labels that are null, or whose
doc_id is null or not in ``documents``, teach nothing. With no labels of one of the kinds, every score is the share
of label 1 (0.0 with no labels at all). Repeated rows are scored each. Extra columns are passed on; one that clashes with
an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm.common import hash_strings, raw, slices, tune, words

#: Structure statistics by text, each cut into buckets.
STATS = ("upper", "marks", "digits", "distinct", "word_length", "lines", "repeated_lines", "odd_words", "words", "n_chars")
BINS = 12
_BYTE = np.arange(256)
UPPER = ((_BYTE >= 65) & (_BYTE <= 90)).astype(np.int64)
DIGIT = ((_BYTE >= 48) & (_BYTE <= 57)).astype(np.int64)
SPACE = ((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))).astype(np.int64)
MARK = (((_BYTE > 32) & (_BYTE < 127)) & ~(((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122)) & ~((_BYTE >= 48) & (_BYTE <= 57))).astype(np.int64)
LINE = (_BYTE == 10).astype(np.int64)


@dataclass(frozen=True)
class QualityConfig:
    """Bounds on the training sample hold at every input size; scoring covers all rows."""

    train_by_label: int = 2000
    train_chars: int = 20_000
    buckets: int = 1 << 15
    factors: int = 6
    epochs: int = 4
    #: A small sample is gone through more often, up to so many batches.
    least_batches: int = 300
    batch: int = 64
    rate: float = 0.02
    seed: int = 5


@dataclass
class QualityModel:
    config: QualityConfig
    base: float
    linear: np.ndarray
    factors: np.ndarray
    constant: float | None = None


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _structure(texts: pa.Array, n_chars: np.ndarray, offsets: np.ndarray, codes: np.ndarray, distinct: pa.Array) -> np.ndarray:
    """The bucket of every statistic, by text."""
    data, at = raw(texts)
    size = np.maximum(np.diff(at), 1)
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    kinds = np.unique(rows * max(1, len(distinct)) + codes) // max(1, len(distinct))
    lines = pc.split_pattern(texts, "\n")
    line_at = lines.offsets.to_numpy() - lines.offsets.to_numpy()[0]
    coded = lines.flatten().dictionary_encode()
    line_rows = np.repeat(np.arange(len(n)), np.diff(line_at))
    kept = np.unique(line_rows * (len(coded.dictionary) + 1) + coded.indices.to_numpy()) // (len(coded.dictionary) + 1)
    chars = np.asarray(pc.utf8_length(distinct)).astype(np.float64)
    odd = _sums(MARK[raw(distinct)[0]], raw(distinct)[1]) >= 2 if len(distinct) else np.zeros(0, bool)
    ratio = [
        _sums(UPPER[data], at) / size,
        _sums(MARK[data], at) / size * 4,
        _sums(DIGIT[data], at) / size * 4,
        np.bincount(kinds, minlength=len(n)) / np.maximum(n, 1),
        (np.bincount(rows, chars[codes], minlength=len(n)) if len(codes) else np.zeros(len(n))) / np.maximum(n, 1) / 16,
        (np.diff(line_at) / np.maximum(n, 1)) * 4,
        1 - np.bincount(kept, minlength=len(n)) / np.maximum(np.diff(line_at), 1),
        (np.bincount(rows, odd[codes], minlength=len(n)) if len(codes) else np.zeros(len(n))) / np.maximum(n, 1),
        np.log2(n + 1) / 16,
        np.where(n_chars >= 0, np.log2(np.maximum(n_chars, 0) + 1) / 20, 0.999),
    ]
    return np.stack([np.clip((x * BINS).astype(np.int64), 0, BINS - 1) + k * BINS for k, x in enumerate(ratio)], axis=1)


def features(texts: pa.Array, n_chars: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets by text, and bucket and value of its features. The structure buckets follow the words' buckets."""
    texts = pc.fill_null(texts, "")
    offsets, codes, distinct = words(texts)
    bucket = (hash_strings(distinct, seed=3) % np.uint64(buckets)).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    key, count = np.unique(rows * buckets + bucket[codes], return_counts=True)
    row, word = key // buckets, key % buckets
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(texts)))
    value = value / np.maximum(norm, 1e-9)[row]
    declared = np.asarray(pc.fill_null(pc.cast(n_chars, pa.float64()), -1.0))
    extra = _structure(texts, declared, offsets, codes, distinct) + buckets
    all_rows = np.concatenate([row, np.repeat(np.arange(len(texts)), extra.shape[1])])
    order = np.argsort(all_rows, kind="stable")
    ids = np.concatenate([word, extra.ravel()])[order].astype(np.int32)
    values = np.concatenate([value, np.full(extra.size, 0.5)])[order]
    return np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=len(texts)))]), ids, values.astype(np.float32)


def logits(model: QualityModel, at: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Every text has features (its structure buckets), so no run is empty."""
    starts = at[:-1]
    vx = model.factors[ids] * values[:, None]
    total, squares = np.add.reduceat(vx, starts, axis=0), np.add.reduceat(vx * vx, starts, axis=0)
    return model.base + np.add.reduceat(model.linear[ids] * values, starts) + 0.5 * (total**2 - squares).sum(axis=1)


def _train(texts: list[str], n_chars: np.ndarray, labels: np.ndarray, cfg: QualityConfig) -> QualityModel:
    rng = np.random.default_rng(cfg.seed)
    n = cfg.buckets + len(STATS) * BINS
    model = QualityModel(cfg, 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, cfg.factors)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.0
        return model
    parts = [features(pa.array(texts[k : k + 100], pa.string()), pa.array(n_chars[k : k + 100]), cfg.buckets) for k in range(0, len(texts), 100)]  # the driver is small
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[0]) for x in parts]))])
    ids, values = (np.concatenate([x[k] for x in parts]) for k in (1, 2))
    weight = np.where(labels == 1, 1.0, (labels == 1).sum() / (labels == 0).sum())
    grads = {"w": np.full(n, 1e-3, np.float32), "v": np.full((n, cfg.factors), 1e-3, np.float32), "b": 1e-3}
    epochs = max(cfg.epochs, -(-cfg.least_batches * cfg.batch // max(1, len(texts))))
    epochs = min(epochs, cfg.least_batches)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), cfg.batch):
            docs = order[k : k + cfg.batch]
            pick = np.concatenate([np.arange(at[d], at[d + 1]) for d in docs])
            own = np.concatenate([[0], np.cumsum(at[docs + 1] - at[docs])])
            i, x = ids[pick], values[pick]
            p = 1 / (1 + np.exp(-np.clip(logits(model, own, i, x), -30, 30)))
            d = np.repeat(((p - labels[docs]) * weight[docs]).astype(np.float32), np.diff(own))
            vx = model.factors[i] * x[:, None]
            total = np.repeat(np.add.reduceat(vx, own[:-1], axis=0), np.diff(own), axis=0)
            used, back = np.unique(i, return_inverse=True)
            gw, gv = np.zeros(len(used), np.float32), np.zeros((len(used), cfg.factors), np.float32)
            np.add.at(gw, back, d * x)
            np.add.at(gv, back, (d * x)[:, None] * (total - vx))
            gw, gv = gw / len(docs) + 1e-4 * model.linear[used], gv / len(docs) + 1e-4 * model.factors[used]
            gb = float(((p - labels[docs]) * weight[docs]).mean())
            grads["w"][used] += gw * gw
            grads["v"][used] += gv * gv
            grads["b"] += gb * gb
            model.linear[used] -= cfg.rate * 10 * gw / np.sqrt(grads["w"][used])
            model.factors[used] -= cfg.rate * gv / np.sqrt(grads["v"][used])
            model.base -= cfg.rate * gb / grads["b"] ** 0.5
    return model


def fit(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), learn_from=None) -> QualityModel:
    """Trains on a bounded sample of labelled rows: those with the smallest hash of doc_id, by label.

    ``learn_from``: a condition on labels that a row must meet to be learnt from.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.train_by_label) for y in (0, 1)]
    n_chars = F.col("n_chars").cast("double") if "n_chars" in documents.columns else F.lit(-1.0)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(n_chars, F.lit(-1.0)).alias("n_chars")).where(F.length("text") <= config.train_chars)
    # of rows that share a doc_id the text of the smallest hash, so the bound on doc_ids is one on rows
    one = F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars")).alias("t")
    got = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id").agg(one, F.max("y").alias("y")).select("doc_id", "t.*", "y").toPandas().sort_values("doc_id")
    return _train(got["text"].tolist(), got["n_chars"].to_numpy(np.float64), got["y"].to_numpy(np.int64), config)


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    spark = documents.sparkSession
    tune(spark)
    documents = documents.drop("score", "predicted")
    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    held = spark.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch):
                names = part.schema.names
                if m.constant is not None:
                    p = np.full(part.num_rows, m.constant)
                else:
                    declared = part.column(names.index("n_chars")) if "n_chars" in names else pa.nulls(part.num_rows, pa.int64())
                    p = 1 / (1 + np.exp(-np.clip(logits(m, *features(part.column(names.index("text")), declared, m.config.buckets)), -30, 30)))
                flag = (p >= 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.astype(np.float64)), pa.array(flag)], names=[*names, "score", "predicted"])

    return documents.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.common import held_out, table

    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fit(docs, table(spark, sf_dir, "labels"), learn_from=~held_out(3, 1))
    return score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
