"""Substring dedup by level-wise doubling: removes words covered by windows of words that also start elsewhere.

The first level are grams of 8 words: cells of windows meet by their anchor gram (see ``repeats``). Windows that agree on 8 words with
another place are extended to 16, those that still do to 32, and those to the window of 35 (the last doubling is cut there),
until no candidates survive. Every level is a count of digests over all that survived the one before, pre-aggregated before the
shuffle, so no task gathers the places of a frequent gram; a place whose whole neighbourhood comes again is settled at once.

Edge cases: a null text has no words; a text with fewer words than the window loses nothing; repeated rows are places like
any others, so both lose what they share. Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tesselar.llm.common import Scratch, table
from tesselar.llm.repeats import ROW, RepeatConfig, repeated, with_spans

#: Blocks of 20, 4 and 1 windows agree on 16, 32 and 35 words.
CONFIG = RepeatConfig("words", 35, 8, (20, 4, 1))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _kept(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], list[str]]:
    all_words = WORD.findall(text)
    if not len(starts):
        return all_words, all_words
    return all_words, [w for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(all_words)], strict=True) for w in all_words[a:b]]


def remove(documents: DataFrame, config: RepeatConfig = CONFIG) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text) and kept: the words left, joined by one space."""
    docs, found = repeated(documents, config, None, Scratch(documents.sparkSession))
    return with_spans(docs, found, [T.StructField("kept", T.StringType())], lambda text, s, e: (" ".join(_kept(text, s, e)[1]),))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = repeated(table(spark, sf_dir, "documents"), CONFIG, None, Scratch(spark))

    def digest(text, starts, ends):
        every, kept = _kept(text, starts, ends)
        return len(every), len(every) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()

    names = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    return with_spans(docs, found, [T.StructField(*x) for x in names.items()], digest).drop(*ROW[1:])
