"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of hashed rows for the word and its first three, four and five letters. Filters over one,
two and three words are max-pooled over the whole text and feed one logistic unit. A word's share in every filter is
worked out once by distinct word, so a text costs a few gathers and additions by word.

Thresholds are calibrated by the language that the text itself suggests (function words); the columns lang, source,
doc_id and labels are never inputs of a score.

Edge cases: a null text counts as empty; an empty text scores what padding alone scores. Labels that are null, or
whose doc_id is null or not in ``documents``, teach nothing. With no labels of one of the kinds, every score is the share
of label 1 (0.0 with no labels at all). Repeated rows are scored each. Extra columns of the input are passed on; one that
clashes with an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm.common import hash_strings, slices, tune, words

#: Frequent function words by language, for choosing a threshold only.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "this", "are"],
    "de": ["der", "die", "und", "das", "von", "zu", "mit", "ist", "nicht", "ein", "für", "sich"],
    "fr": ["le", "la", "les", "et", "des", "un", "une", "que", "dans", "pour", "est", "pas"],
    "es": ["el", "los", "las", "y", "del", "que", "en", "una", "por", "con", "para", "se"],
}
MARKS = " .,;:!?*\"'()[]#%&$|-"


@dataclass(frozen=True)
class ToxicityConfig:
    """Bounds on the training sample hold at every input size; scoring covers all rows."""

    train_positive: int = 2000
    train_negative: int = 4000
    train_chars: int = 20_000
    buckets: int = 1 << 15
    dim: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 4
    #: A small sample is gone through more often, up to so many batches.
    least_batches: int = 300
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class ToxicityModel:
    config: ToxicityConfig
    embed: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    constant: float | None = None
    shift: dict[int, float] = field(default_factory=dict)


def _features(distinct: pa.Array, buckets: int) -> np.ndarray:
    """Four buckets by distinct word: the word and its first letters."""
    plain = pc.utf8_trim(pc.utf8_lower(distinct), characters=MARKS)
    kinds = [plain, *(pc.utf8_slice_codeunits(plain, 0, n) for n in (3, 4, 5))]
    return np.stack([(hash_strings(x, seed=k) % np.uint64(buckets)).astype(np.int64) for k, x in enumerate(kinds)], axis=1)


def _languages(distinct: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By text 1 + the place of the language with most function words in it, 0 without any."""
    plain = pc.utf8_trim(pc.utf8_lower(distinct), characters=MARKS)
    counts = np.zeros((len(offsets) - 1, len(FUNCTION_WORDS)))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k, known in enumerate(FUNCTION_WORDS.values()):
        hit = np.asarray(pc.is_in(plain, value_set=pa.array(known)))[codes]
        counts[:, k] = np.bincount(rows[hit], minlength=len(offsets) - 1)
    return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1) + 1, 0)


def _padded(codes: np.ndarray, offsets: np.ndarray, blank: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with ``pad`` blanks after every text, and the first and the end of its windows (at least one)."""
    size = np.diff(offsets)
    starts = offsets[:-1] + pad * np.arange(len(size))
    out = np.full(len(codes) + pad * len(size), blank, np.int64)
    out[np.arange(len(codes)) + pad * np.repeat(np.arange(len(size)), size)] = codes
    return out, starts, starts + np.maximum(size, 1)


def _train(texts: list[str], labels: np.ndarray, cfg: ToxicityConfig) -> ToxicityModel:
    rng = np.random.default_rng(cfg.seed)
    model = ToxicityModel(
        cfg,
        rng.normal(0, 0.3, (cfg.buckets, cfg.dim)).astype(np.float32),
        {w: rng.normal(0, 0.3, (w, cfg.dim, cfg.filters)).astype(np.float32) for w in cfg.widths},
        {w: np.zeros(cfg.filters, np.float32) for w in cfg.widths},
        rng.normal(0, 0.3, cfg.filters * len(cfg.widths)).astype(np.float32),
        0.0,
    )
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.0
        return model
    offsets, codes, distinct = words(pa.array(texts, pa.string()))
    features = np.vstack([_features(distinct, cfg.buckets), np.zeros((1, 4), np.int64)])
    blank, pad, n_f = len(distinct), max(cfg.widths), cfg.filters
    fit = np.arange(len(texts)) % 5 != 4
    params = {"embed": model.embed, "out": model.out, **{f"c{w}": model.conv[w] for w in cfg.widths}, **{f"b{w}": model.bias[w] for w in cfg.widths}, "ob": np.zeros(1, np.float32)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    weight = np.where(labels == 1, min(4.0, (labels == 0).sum() / max(1, (labels == 1).sum())), 1.0)
    step = 0
    epochs = max(cfg.epochs, -(-cfg.least_batches * cfg.batch // max(1, int(fit.sum()))))
    epochs = min(epochs, cfg.least_batches)
    for epoch in range(epochs):
        order = rng.permutation(np.flatnonzero(fit))
        rate = cfg.rate * (1 - epoch / epochs)
        for at in range(0, len(order), cfg.batch):
            docs = order[at : at + cfg.batch]
            own = np.concatenate([codes[offsets[d] : offsets[d + 1]] for d in docs]) if len(docs) else codes[:0]
            size = np.concatenate([[0], np.cumsum(offsets[docs + 1] - offsets[docs])])
            seq, starts, ends = _padded(own, size, blank, pad)
            used, seq = np.unique(seq, return_inverse=True)
            live = (used != blank).astype(np.float32)[:, None]
            vec = params["embed"][features[used]].mean(axis=1) * live
            x = vec[seq]
            picked, pooled = {}, []
            for w in cfg.widths:
                pre = sum(x[j : len(x) - w + 1 + j] @ params[f"c{w}"][j] for j in range(w))
                best = np.stack([s + pre[s:e].argmax(axis=0) for s, e in zip(np.minimum(starts, len(pre) - 1), np.minimum(ends, len(pre)), strict=True)])
                picked[w] = best
                pooled.append(np.take_along_axis(pre, best, axis=0) + params[f"b{w}"])
            z = np.concatenate(pooled, axis=1)
            hidden = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params["out"] + params["ob"][0], -30, 30)))
            d = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            grads = {"out": hidden.T @ d, "ob": np.array([d.sum()], np.float32)}
            dz = (d[:, None] * params["out"][None, :]) * (z > 0)
            dvec = np.zeros_like(vec)
            for k, w in enumerate(cfg.widths):
                g = dz[:, k * n_f : (k + 1) * n_f]
                grads[f"b{w}"] = g.sum(axis=0)
                gw = np.zeros_like(params[f"c{w}"])
                for j in range(w):
                    at_word = seq[picked[w] + j]
                    gw[j] = np.einsum("dfk,df->kf", vec[at_word], g)
                    np.add.at(dvec, at_word.ravel(), (g[:, :, None] * params[f"c{w}"][j].T[None]).reshape(-1, cfg.dim))
                grads[f"c{w}"] = gw
            grads["embed"] = np.zeros_like(params["embed"])
            touched = np.flatnonzero(np.abs(dvec).sum(axis=1) * live[:, 0])
            np.add.at(grads["embed"], features[used[touched]].ravel(), np.repeat(dvec[touched] / 4, 4, axis=0))
            step += 1
            for key, g in grads.items():
                first[key] += 0.1 * (g - first[key])
                second[key] += 0.01 * (g * g - second[key])
                params[key] -= rate * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-6)
    model.embed, model.out, model.out_bias = params["embed"], params["out"], float(params["ob"][0])
    model.conv, model.bias = {w: params[f"c{w}"] for w in cfg.widths}, {w: params[f"b{w}"] for w in cfg.widths}
    parts = [_logits(model, pa.array(texts[k : k + 100], pa.string())) for k in range(0, len(texts), 100)]  # the driver is small
    logit, language = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    for k in range(len(FUNCTION_WORDS) + 1):
        own = ~fit & ((language == k) | (k == 0))
        if (labels[own] == 1).sum() < 5:
            model.shift[k] = model.shift.get(0, 0.0)
            continue
        cuts = np.unique(logit[own])
        cuts = (cuts[:-1] + cuts[1:]) / 2 if len(cuts) > 1 else cuts
        right = [(logit[own][labels[own] == 1] > c).mean() + (logit[own][labels[own] == 0] <= c).mean() * 2 for c in cuts]
        best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
        model.shift[k] = float(cuts[best[len(best) // 2]])
    return model


def _logits(model: ToxicityModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cfg = model.config
    offsets, codes, distinct = words(texts)
    language = _languages(distinct, codes, offsets)
    pad = max(cfg.widths)  # an empty text has a window of blanks of its own
    seq, starts, ends = _padded(codes, offsets, len(distinct), pad)
    vec = model.embed[_features(distinct, cfg.buckets)].mean(axis=1) if len(distinct) else np.zeros((0, cfg.dim), np.float32)
    vec = np.vstack([vec, np.zeros((1, cfg.dim), np.float32)])
    spans = np.stack([starts, ends], axis=1).ravel()
    total = np.full(len(starts), model.out_bias)
    for k, w in enumerate(cfg.widths):
        shares = [vec @ model.conv[w][j] for j in range(w)]
        n = len(seq) - w + 1
        pre = shares[0][seq[:n]]
        for j in range(1, w):
            pre += shares[j][seq[j : n + j]]
        pre = np.vstack([pre, pre[-1:]])  # the last end may be the array's own
        top = np.maximum.reduceat(pre, np.minimum(spans, n), axis=0)[::2]
        total += np.maximum(top + model.bias[w], 0) @ model.out[k * cfg.filters : (k + 1) * cfg.filters]
    return total, language


def fit(documents: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), learn_from=None) -> ToxicityModel:
    """Trains on a bounded sample of labelled rows: those with the smallest hash of doc_id, by label.

    ``learn_from``: a condition on labels that a row must meet to be learnt from.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    pick = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, config.train_positive).unionByName(pick(0, config.train_negative))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= config.train_chars)
    # of rows that share a doc_id the text of the smallest hash, so the bound on doc_ids is one on rows
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).toPandas().sort_values("doc_id")
    got = got.iloc[np.random.default_rng(config.seed).permutation(len(got))]
    return _train(got["text"].tolist(), got["y"].to_numpy(np.int64), config)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
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
                if m.constant is not None:
                    p = np.full(part.num_rows, m.constant)
                else:
                    logit, language = _logits(m, part.column(part.schema.get_field_index("text")))
                    shift = np.array([m.shift[k] for k in range(len(FUNCTION_WORDS) + 1)])
                    p = 1 / (1 + np.exp(-np.clip(logit - shift[language], -30, 30)))
                flag = (p >= 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(flag)], names=[*part.schema.names, "score", "predicted"])

    return documents.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.common import held_out, table

    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learn_from=~held_out(5, 0))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
