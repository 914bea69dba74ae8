import numpy as np
import pytest

from tesselar.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
ROWS = [(1, "a b", 3, "x"), (2, None, None, None), (None, "", -1, "y"), (2, None, None, None), (4, "word " * 30_000, 5, "z")]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_edges(spark, module, label):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 0)], f"doc_id long, {label} int")
    model = module.fit(df, labels)
    assert model.constant == 1.0
    out = module.score(df, model).collect()
    assert len(out) == len(ROWS) and all(r.predicted == 1 for r in out)
    assert module.fit(df, labels.limit(0)).constant == 0.0
    both = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], f"doc_id long, {label} int")
    out = module.score(df, module.fit(df, both)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert module.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize("query,label", [(toxicity.op1_toxicity, "toxic"), (quality.op5_quality, "quality")])
def test_held_out(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in query(spark, SF).collect() if r.held_out and labels.get(r.doc_id) is not None]
    one, zero = (np.array([s for s, y in rows if y == k]) for k in (1, 0))
    assert len(rows) > 20 and len(one) and len(zero)
    assert (one[:, None] > zero[None, :]).mean() > 0.9


def test_scores_do_not_see_columns(spark):
    df = spark.createDataFrame([(1, "the idiot", "en", "s1"), (99, "the idiot", "de", "s2")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (99, 0)], "doc_id long, toxic int")
    a, b = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert a.score == b.score


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_repeated_ids_and_clashing_columns(spark, module, label):
    """Rows that share a doc_id give one training row whatever their order; a column named like an output is replaced."""
    rows = [(k // 2, f"text {k} " + ("good fine" if k % 4 < 2 else "bad awful"), 7, "x") for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], f"doc_id long, {label} int")
    schema = "doc_id long, text string, predicted int, score string"
    scores = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema).repartition(3)
        out = module.score(df, module.fit(df, labels))
        assert out.columns == ["doc_id", "text", "score", "predicted"]
        scores.append(sorted((r.doc_id, r.text, round(r.score, 6), r.predicted) for r in out.collect()))
    assert scores[0] == scores[1]


def test_null_id_is_not_held_out(spark):
    from tesselar.llm.common import held_out

    assert not spark.createDataFrame([(None,)], "doc_id long").select(held_out(5, 0).alias("h")).first().h
