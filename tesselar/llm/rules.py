"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Rules read measures of the text (words, lines, characters); a measure is made once for a run
of documents, and only for those that no earlier rule has rejected. The order of the rules is estimated on a bounded sample: the next
rule is always the one that rejects most of the sample's documents still kept for each second that it takes, where a measure that
an earlier rule has made already costs nothing. The order decides how much work is done, never which documents are kept.

Base measures of ``op11_rules``: code points in words, characters of ``#*$%&|<>``, lines with a word equal to an earlier line, and words
in three-word windows that occur twice or more in the text. Windows are compared by exact codes of words, not by hashes.

Edge cases: a null text is an empty one and has no words (rejected); repeated rows and null ids are documents of their own; other columns
are passed through by ``keep`` and not read by the query. A table without rows gives an empty result, in the order in which rules
are listed. A text is never cut: one longer than a run is a run of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import gathered, raw, slices, table, tune, words

SYMBOLS = "#*$%&|<>"


class Texts:
    """A run of texts and the measures made of it so far."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "")
        self.n = len(texts)
        self._made: dict[str, object] = {}

    def get(self, name: str):
        if name not in self._made:
            self._made[name] = MEASURES[name](self)
        return self._made[name]

    def taken(self, rows: np.ndarray) -> Texts:
        """The rows' texts, with what has been made of them: nothing is split again."""
        out = Texts(self.texts.take(pa.array(rows)))
        for k, v in self._made.items():
            if k == "words":
                offsets, codes, distinct = v
                size = np.diff(offsets)[rows]
                ends = np.cumsum(size)
                at = np.repeat(offsets[:-1][rows] - ends + size, size) + np.arange(size.sum())
                out._made[k] = np.concatenate([[0], ends]).astype(np.int64), codes[at], distinct
            elif k == "lines":
                row, codes, distinct = v
                to = np.full(self.n, -1)
                to[rows] = np.arange(len(rows))
                live = to[row] >= 0
                out._made[k] = to[row[live]], codes[live], distinct
            else:
                out._made[k] = v[rows]
        return out


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, n).astype(np.int64)


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _word_chars(t: Texts) -> np.ndarray:
    offsets, codes, distinct = t.get("words")
    return per_row(_rows(offsets), t.n, np.asarray(pc.utf8_length(distinct)).astype(np.int64)[codes])


def _bytes_in(t: Texts, members: str) -> np.ndarray:
    data, offsets = raw(t.texts)
    wanted = np.zeros(256, np.int64)
    wanted[list(members.encode())] = 1
    seen = np.concatenate([[0], np.cumsum(wanted[data])])
    return np.diff(seen[offsets])


def _repeat_words(t: Texts) -> np.ndarray:
    """Words covered by three-word windows found twice or more in their text."""
    offsets, codes, distinct = t.get("words")
    total, row = len(codes), _rows(offsets)
    if total < 3:
        return np.zeros(t.n, np.int64)
    codes = codes.astype(np.int64)
    pair = np.unique(codes[:-1] * len(distinct) + codes[1:], return_inverse=True)[1]
    triple = np.unique(pair[:-1] * len(distinct) + codes[2:], return_inverse=True)[1]
    first = np.flatnonzero(row[:-2] == row[2:])  # windows within one text
    _, which, times = np.unique(row[first] * total + triple[first], return_inverse=True, return_counts=True)
    again = first[times[which] > 1]
    covered = np.zeros(total, bool)
    for k in range(3):
        covered[again + k] = True
    return per_row(row[covered], t.n)


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and code of every line that has a word, and by row how many these are."""
    parts = pc.split_pattern(t.texts, "\n")
    coded = parts.flatten().dictionary_encode()
    full = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary))) > 0
    row, codes = _rows(parts.offsets.to_numpy().astype(np.int64)), coded.indices.to_numpy().astype(np.int64)
    keep = full[codes] if len(codes) else np.zeros(0, bool)
    return row[keep], codes[keep], coded.dictionary


def _dup_lines(t: Texts) -> np.ndarray:
    row, codes, distinct = t.get("lines")
    once = np.unique(row * max(1, len(distinct)) + codes) // max(1, len(distinct))
    return per_row(row, t.n) - per_row(once, t.n)


def _lines_matching(t: Texts, pattern: str) -> np.ndarray:
    row, codes, distinct = t.get("lines")
    hit = np.asarray(pc.match_substring_regex(distinct, pattern)).astype(np.int64)
    return per_row(row, t.n, hit[codes] if len(codes) else None)


def _letter_words(t: Texts) -> np.ndarray:
    """Words that hold a letter."""
    offsets, codes, distinct = t.get("words")
    hit = np.asarray(pc.match_substring_regex(distinct, r"\pL")).astype(np.int64)
    return per_row(_rows(offsets), t.n, hit[codes] if len(codes) else None)


def _distinct_words(t: Texts) -> np.ndarray:
    offsets, codes, distinct = t.get("words")
    once = np.unique(_rows(offsets) * max(1, len(distinct)) + codes) // max(1, len(distinct))
    return per_row(once, t.n)


MEASURES: dict[str, Callable[[Texts], object]] = {
    "words": lambda t: words(t.texts),
    "lines": _lines,
    "n_words": lambda t: np.diff(t.get("words")[0]),
    "word_chars": _word_chars,
    "n_symbols": lambda t: _bytes_in(t, SYMBOLS),
    "n_repeat_words": _repeat_words,
    "n_lines": lambda t: per_row(t.get("lines")[0], t.n),
    "n_dup_lines": _dup_lines,
    "bullet_lines": lambda t: _lines_matching(t, r"^\s*([-*+]|\x{2022})\s"),
    "ellipsis_lines": lambda t: _lines_matching(t, r"(\.\.\.|\x{2026})\s*$"),
    "braces": lambda t: _bytes_in(t, "{}"),
    "letter_words": _letter_words,
    "distinct_words": _distinct_words,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``rejects`` of its measures (in the order of ``needs``) holds."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: Integer comparisons only, so that every machine gives the same verdict.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 10 * d > 3 * n),
    Rule("bullets", ("n_lines", "bullet_lines"), lambda n, b: 10 * b > 9 * n),
    Rule("ellipses", ("n_lines", "ellipsis_lines"), lambda n, e: 10 * e > 3 * n),
    Rule("code", ("n_words", "braces"), lambda n, b: 20 * b > n),
    Rule("letters", ("n_words", "letter_words"), lambda n, w: 10 * w < 7 * n),
    Rule("one_word", ("n_words", "distinct_words"), lambda n, d: 20 * d < np.minimum(n, 1000)),
)


@dataclass(frozen=True)
class RuleConfig:
    rules: tuple[Rule, ...] = RULES
    #: Bound of the sample that costs and selectivities are estimated on: documents, and characters of each.
    sample: int = 2000
    sample_chars: int = 20_000


@dataclass
class Plan:
    """Rules in the order in which they are tried, and what the sample says of each: seconds by document, share rejected."""

    order: tuple[Rule, ...]
    seconds: dict[str, float] = field(default_factory=dict)
    rejected: dict[str, float] = field(default_factory=dict)


def _try(rule: Rule, t: Texts) -> tuple[np.ndarray, float]:
    began = time.perf_counter()
    out = rule.rejects(*(t.get(m) for m in rule.needs))
    return out, time.perf_counter() - began


def estimate(texts: pa.Array, cfg: RuleConfig, paid: tuple[str, ...] = ()) -> Plan:
    """Greedy order on the sample: most rejections of what is still kept for each second. ``paid``: measures that are made anyway."""
    left = Texts(texts)
    for m in paid:
        left.get(m)
    plan, rest = [], list(cfg.rules)
    out = Plan(())
    while rest:
        n = max(1, left.n)
        tried = []
        for k, rule in enumerate(rest):
            fresh = Texts(left.texts)
            fresh._made = dict(left._made)  # what earlier rules have made costs nothing
            bad, s = _try(rule, fresh)
            s = max(s, 1e-7) / n
            tried.append((-(bad.mean() if left.n else 0.0) / s, s, k, bad, fresh))
        _, s, k, bad, fresh = min(tried, key=lambda x: x[:3])
        rule = rest.pop(k)
        plan.append(rule)
        out.seconds[rule.name], out.rejected[rule.name] = s, float(bad.mean()) if left.n else 0.0
        left = fresh if not bad.any() else fresh.taken(np.flatnonzero(~bad))
    out.order = tuple(plan)
    return out


def sampled(documents: DataFrame, cfg: RuleConfig) -> pa.Array:
    """Texts to estimate on: a bounded sample by hash, the same for the same rows. Only about twice as many rows as it holds leave their tasks."""
    share = min(1.0, 2 * cfg.sample / max(1, documents.count()))
    h = F.xxhash64(*(c for c in ("doc_id", "text") if c in documents.columns))
    some = documents.where((F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))) & F.col("text").isNotNull())
    rows = some.select(F.substring("text", 1, cfg.sample_chars).alias("text"), h.alias("h")).orderBy("h", "text").limit(cfg.sample)
    return rows.select("text").toArrow().column(0).combine_chunks().cast(pa.string())


def passes(t: Texts, order: tuple[Rule, ...]) -> np.ndarray:
    """Which texts no rule rejects; every rule sees only what the rules before it have kept."""
    kept = np.zeros(t.n, bool)
    rows = np.arange(t.n)
    for rule in order:
        if not len(rows):
            break
        bad, _ = _try(rule, t)
        if bad.any():
            live = np.flatnonzero(~bad)
            rows, t = rows[live], t.taken(live)
    kept[rows] = True
    return kept


def keep(documents: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Rows of ``documents`` that no rule rejects, with all their columns."""
    tune(documents.sparkSession)
    order = estimate(sampled(documents, cfg), cfg).order
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(passes(Texts(part.column(at)), order)))

    return documents.mapInArrow(run, documents.schema)


def measured(documents: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every document; rules are tried on what the base leaves."""
    tune(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    order = estimate(sampled(docs, cfg), cfg, BASE).order
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 1 << 20):
            t = Texts(part.column(1))
            base = {m: t.get(m) for m in BASE}
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            live = np.flatnonzero(~failed)
            kept = np.zeros(t.n, bool)
            kept[live] = passes(t.taken(live), order)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(base[m].astype(np.int64)) for m in BASE), pa.array(failed), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "kept"])

    return docs.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{m} long' for m in BASE)}, base_failed boolean, kept boolean")


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"))
