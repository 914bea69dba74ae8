import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.llm import rules as R


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def base(texts):
    t = R.Texts(pa.array(texts, pa.string()))
    return list(zip(*(np.asarray(t.get(m)).tolist() for m in R.BASE), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#$é一\x0b\x1c ", max_size=40)), min_size=1, max_size=6))
def test_base_measures(texts):
    assert base(texts) == [plain(t) for t in texts]


TEXTS = [
    None, "", " \n", "one two three " * 40, " ".join(f"w{k}" for k in range(80)), " ".join(f"word{k}" for k in range(49)), "# " * 60 + " ".join(f"v{k}" for k in range(60)),
    "\n".join(["the same line of words"] * 3 + [" ".join(f"u{k}" for k in range(60))]), "\n".join(f"- item {k} of a list" for k in range(40)), "\n".join(f"so it goes on {k} ..." for k in range(40)),
    "{} " * 30 + " ".join(f"c{k}" for k in range(60)), " ".join(str(k) for k in range(90)), " ".join(f"z{k}" for k in range(200_000)),
]


def test_order_never_changes_the_verdict():
    t = R.Texts(pa.array(TEXTS, pa.string()))
    one_by_one = ~np.any([R._try(rule, t)[0] for rule in R.RULES], axis=0)
    for order in (R.RULES, R.RULES[::-1], R.RULES[3:] + R.RULES[:3]):
        assert (R.passes(R.Texts(pa.array(TEXTS, pa.string())), order) == one_by_one).all()
    assert one_by_one.tolist()[4] and one_by_one.tolist()[12] and not one_by_one[[0, 1, 2, 3, 5, 6, 8, 9, 10, 11]].any()


def test_later_rules_see_only_what_is_kept():
    seen = []
    few = R.Rule("few", ("n_words",), lambda n: n < 3)
    probe = R.Rule("probe", ("n_words",), lambda n: (seen.append(len(n)), n < 0)[1])
    assert R.passes(R.Texts(pa.array(["a b c", "a", None, "c d e f"])), (few, probe)).tolist() == [True, False, False, True]
    assert seen == [2]


def test_order_is_by_rejections_per_second():
    import time

    cheap = R.Rule("cheap", ("n_words",), lambda n: n < 3)
    dear = R.Rule("dear", ("n_words",), lambda n: (time.sleep(0.02), n < 3)[1])
    idle = R.Rule("idle", ("n_words",), lambda n: n < 0)
    plan = R.estimate(pa.array(["a b c", "a", "b", "c d e f"] * 20), R.RuleConfig((idle, dear, cheap)), ("n_words",))
    assert plan.order[0].name == "cheap" and plan.rejected["cheap"] == 0.5 and plan.rejected["dear"] == 0.0
    assert R.estimate(pa.array([], pa.string()), R.RuleConfig()).order[0] in R.RULES


def test_over_a_table(spark):
    rows = [(k, t, 0) for k, t in enumerate(TEXTS)] + [(None, TEXTS[4], 1), (4, TEXTS[4], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    got = sorted((tuple(r) for r in R.measured(df).collect()), key=repr)
    want = []
    for k, t, _ in rows:
        m = plain(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((k, *m, failed, not failed and bool(R.passes(R.Texts(pa.array([t], pa.string())), R.RULES)[0])))
    assert got == sorted(want, key=repr)
    kept = R.keep(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[-1]), key=repr)
    empty = df.limit(0)
    assert R.measured(empty).count() == 0 and R.keep(empty).count() == 0


@pytest.mark.parametrize("word", ["a", "ab"])
def test_overlapping_windows(word):
    assert base([" ".join([word] * 5)])[0][-1] == 5 and base([" ".join([word] * 3)])[0][-1] == 0
