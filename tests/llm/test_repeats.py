import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tesselar.llm import repeats, substring_dedup, suffix_dedup
from tesselar.llm.common import Scratch, by_group


def brute(sequences, window):
    """By sequence: whether each symbol is covered by a window that starts at two places."""
    count = Counter(bytes(s[i : i + window]) if isinstance(s, bytes) else tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if count[bytes(s[i : i + window]) if isinstance(s, bytes) else tuple(s[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 4)))
    passages = [" ".join(word() for _ in range(rng.integers(8, 60))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts.append(str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.integers(1, 30))))
        texts.append(" ".join(parts))
    texts += [texts[3]] * 3 + ["ab " * 60, "ab " * 60, "a" * 200, "", None, texts[5] + " x", "y " + texts[5]]
    return texts


def runs(gone):
    d = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
    return int((d == 1).sum())


@pytest.mark.parametrize("levels,most", [((8, 4, 1), 1024), ((8, 2, 1), 2), ((16, 1), 0), ((1,), 0)])
def test_bytes(spark, levels, most):
    texts = corpus(1)
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, t1 int").repartition(3)
    cfg = repeats.RepeatConfig("bytes", 40, 12, levels, most)
    docs, found = repeats.repeated(df, cfg, suffix_dedup.kernel(40), Scratch(spark))
    spans = {r.doc_id: r.spans for r in found.collect()}
    for k, gone in enumerate(brute([(t or "").encode() for t in texts], 40)):
        mine = np.zeros(len(gone), bool)
        for s, e in spans.get(k, []):
            mine[s:e] = True
        assert (mine == gone).all(), (k, texts[k])


@pytest.mark.parametrize("levels", [(8, 4, 1), (1,)])
def test_words(spark, levels):
    texts = corpus(2)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    cfg = repeats.RepeatConfig("words", 12, 3, levels)
    got = {r.doc_id: r.kept for r in substring_dedup.remove(df, cfg).collect()}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for k, gone in enumerate(brute(split, 12)):
        assert got[k] == " ".join(w for w, g in zip(split[k], gone, strict=True) if not g)


def suffixes(seed=3, n=300):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 2000).astype(np.uint8)
    place, size = rng.integers(0, 1900, n), rng.integers(0, 90, n)
    cut = np.sort(rng.integers(0, n, 5))
    edges = np.concatenate([[0], cut, [n]])
    start = np.repeat(edges[:-1], np.diff(edges))
    end = np.repeat(edges[1:], np.diff(edges))
    return data, place, size, start, end


@pytest.mark.parametrize("lies", [False, True])
def test_suffix_mergesort(lies):
    """Orders and common extensions equal those of plain sorting; a hash that calls everything equal is found out."""
    data, place, size, start, end = suffixes()
    h = (lambda at, n: np.zeros(len(at), np.uint64)) if lies else repeats.PrefixHash(repeats.BY_BYTE[data])
    order, shared = suffix_dedup.neighbours(h, data, place, size, start, end)
    text = [bytes(data[p : p + n]) for p, n in zip(place, size, strict=True)]
    assert [text[k] for k in order] == [text[k] for k in sorted(range(len(place)), key=lambda k: (start[k], text[k]))]
    for k in range(1, len(order)):
        a, b = text[order[k - 1]], text[order[k]]
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if start[k] == start[k - 1] else -1
        assert shared[k] == want


def test_one_task_never_holds_a_common_passage(spark):
    """A passage in most documents, each in its own context: with few stretches to a class allowed, levels settle it."""
    rng = np.random.default_rng(4)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = word(30)
    texts = [f"{word(12)} {passage} {word(12)}" for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1024, 4):
        cfg = repeats.RepeatConfig("bytes", 100, 16, (32, 8, 1), most)
        got = {r.doc_id: r.spans for r in repeats.repeated(df, cfg, suffix_dedup.kernel(100), Scratch(spark))[1].collect()}
        for k, gone in enumerate(brute([t.encode() for t in texts], 100)):
            mine = np.zeros(len(gone), bool)
            for s, e in got[k]:
                mine[s:e] = True
            assert (mine == gone).all()


def test_queries_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    got = {r.doc_id: r for r in suffix_dedup.op9_suffix_dedup(spark, sf).collect()}
    for k, gone in zip(ids, brute([docs[k].encode() for k in ids], 400), strict=True):
        kept = bytes(np.frombuffer(docs[k].encode(), np.uint8)[~gone])
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(gone), int(gone.sum()), runs(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: r for r in substring_dedup.op10_substring_dedup(spark, sf).collect()}
    split = [re.findall(r"[^\x20\x09-\x0D]+", docs[k]) for k in ids]
    for k, s, gone in zip(ids, split, brute(split, 35), strict=True):
        kept = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(s), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())


def test_null_and_repeated_ids_in_word_dedup(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, 1), (1, long, 2), (None, None, 3), (None, "x " + long, 4), (None, "", 5), (2, "a b", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 int")
    got = sorted((r.doc_id or 0, r.kept) for r in substring_dedup.remove(df).collect())
    assert got == [(0, ""), (0, ""), (0, "x"), (1, ""), (1, ""), (2, "a b")]
    assert substring_dedup.remove(df.limit(0)).count() == 0


def test_edges(spark):
    long = "".join(chr(97 + int(x)) for x in np.random.default_rng(0).integers(0, 26, 500))
    rows = [(1, long, "a"), (1, long, "b"), (None, None, None), (None, long + "z", "c"), (2, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = suffix_dedup.remove(df).collect()
    assert sorted((r.doc_id or 0, r.text, r.kept or "") for r in out) == [(0, "", ""), (0, "z", "c"), (1, "", "a"), (1, "", "b"), (2, "", "d")]
    assert suffix_dedup.remove(df.limit(0)).count() == 0


def test_by_group_keeps_groups_whole():
    import pyarrow as pa

    keys = sorted(np.random.default_rng(1).integers(0, 9, 200).tolist())
    seen = []
    batches = [pa.RecordBatch.from_pydict({"g": keys[k : k + 7]}) for k in range(0, 200, 7)]
    list(by_group(iter(batches), "g", lambda t: seen.append(t["g"].to_pylist()), rows=20))
    assert sum(seen, []) == keys and all(not set(a) & set(b) for i, a in enumerate(seen) for b in seen[:i])
