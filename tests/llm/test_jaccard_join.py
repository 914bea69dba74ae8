import re

import numpy as np
import pyarrow as pa
import pytest

from tesselar.llm import jaccard_join as jj


def sets_of(texts, n=3):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute(ids, sets, under=90):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= under * (len(a) + len(sets[j]) - k):
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(int(rng.integers(0, 4000)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(int(rng.choice([1, 2, 3, 5, 11, 12, 13, 30, 60, 150, 300])))]
        for _ in range(int(rng.choice([1, 2, 6, 25]))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, len(own) // 40)))):
                k = int(rng.integers(0, len(own)))
                own[k : k + 1] = [[], [word()], [word(), own[k]]][int(rng.integers(0, 3))]
            texts.append(" ".join(own))
    return [*texts, "", None, "  \n", "A b", "a B", "one"]


@pytest.mark.parametrize("cfg", [jj.JoinConfig(), jj.JoinConfig(pivots=4), jj.JoinConfig(most=8, pivots=3), jj.JoinConfig(under=80, n=5)])
def test_components(spark, cfg):
    texts = corpus(cfg.most % 7)
    want = brute(list(range(len(texts))), sets_of(texts, cfg.n), cfg.under)
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, point long").repartition(3)
    got = jj.similar(df, cfg).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert [r.n_shingles for r in sorted(got)] == [len(s) for s in sets_of(texts, cfg.n)]


def test_linked_pairs_share_a_key():
    cfg = jj.JoinConfig()
    texts = corpus(9)
    at, e = jj.shingles(pa.array(texts), cfg)
    row, key, need = jj.keys(at, e, cfg)
    sent = [dict(zip(key[row == k].tolist(), need[row == k].tolist(), strict=True)) for k in range(len(texts))]
    sets = sets_of(texts)
    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k):
                both = set(sent[i]) & set(sent[j])
                # in some size range they share as many keys as each must
                assert any(sum(x[k] == v for k in both) >= v for x in (sent[i], sent[j]) for v in {x[k] for k in both})


def one_part(k):
    """Eight words whose four shingles of five fall into one part of three; a ninth word links at exactly 0.8."""
    text = " ".join(f"w{k}x{i}" for i in range(8))
    return [text, f"{text} w{k}x8"]


@pytest.mark.parametrize("cfg", [jj.JoinConfig(), jj.JoinConfig(under=80, n=5)])
def test_both_of_a_linked_pair_meet_their_need(cfg):
    texts = [*corpus(9), *(t for k in range(250) for t in one_part(k))]
    at, e = jj.shingles(pa.array(texts), cfg)
    row, key, need = jj.keys(at, e, cfg)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    sent = [dict(zip(key[a:b].tolist(), need[a:b].tolist(), strict=True)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    sets = sets_of(texts, cfg.n)
    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= cfg.under * (len(sets[i]) + len(sets[j]) - k):
                both = set(sent[i]) & set(sent[j])
                # the keys that they share, alone, keep both from being dropped
                assert all(any(sum(x[k] == v for k in both) >= v for v in {x[k] for k in both}) for x in (sent[i], sent[j]))


def test_partner_without_empty_parts(spark):
    cfg = jj.JoinConfig(under=80, n=5)
    # alone in the table: no third class shares the empty parts
    df = spark.createDataFrame(list(enumerate(one_part(35))), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jj.similar(df, cfg).collect()} == {0: 0, 1: 0}


def test_pivots_and_windows_decide_what_meets():
    """A region joined without a first partition: exact, and with far fewer distances than it has pairs."""
    cfg = jj.JoinConfig()
    rng = np.random.default_rng(12)
    shift = lambda base, k: np.concatenate([base[k:], np.arange(k, dtype=np.uint64) + base[-1] + np.uint64(1)])
    sets = []
    for c in range(40):  # chains of sets that slide away from where they begin, each step linked
        base = np.arange(200, dtype=np.uint64) + np.uint64(c * 10**6)
        sets += [np.sort(shift(base, 9 * k)) for k in range(15)]
    sets = [sets[k] for k in rng.permutation(len(sets))]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    region = jj.Region(at, np.concatenate(sets), np.ones(len(sets), bool), cfg)
    region.join(np.arange(len(sets)), np.ones(len(sets), bool))
    want = brute(list(range(len(sets))), [set(s.tolist()) for s in sets])
    assert {k: int(v) for k, v in enumerate(region.label)} == want
    assert region.measured < len(sets) ** 2 / 2 / 4, region.measured


def test_edges(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "x y z q"), (3, "x y z q"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jj.similar(df).collect()) == [(0, None), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
    assert jj.similar(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in jj.keep_one(df, jj.JoinConfig()).collect()) == [0, 1, 4]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(list(docs), sets_of(docs.values()))
    assert {r.doc_id: r.component_id for r in jj.op3_jaccard_join(spark, sf).collect()} == want


@pytest.mark.parametrize("n", range(1, 9))
def test_sets_of_few_words(n):
    """A run of texts that holds fewer words than n in all."""
    for texts in (["a b c d e"[: 2 * k] for k in range(1, 6)], ["a"], ["a b"], ["a b c"], ["a", "b"], ["", None, "a b"], [None], [""], ["a b c d"], ["a b c d e"], ["a b", "", "c"]):
        at, elements = jj.shingles(pa.array(texts, pa.string()), jj.JoinConfig(n=n))
        assert np.diff(at).tolist() == [len(s) for s in sets_of(texts, n)]
        both = {tuple(sorted(s)): tuple(elements[a:b]) for s, a, b in zip(sets_of(texts, n), at[:-1], at[1:], strict=True)}
        assert len(set(both.values())) == len(both)
