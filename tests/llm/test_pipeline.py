import re

import corpus_pipeline
from tesselar.llm import toxicity
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_jaccard_join import sets_of
from tests.llm.test_pii import PLAIN, base
from tests.llm.test_repeats import brute as covered

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == columns
    # accuracy on held-out rows is tested in test_classifiers.py, on tables with enough labels
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    marked = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - marked

    before = {r.doc_id: r.text for r in clean.collect()}
    apart = stages["ngram_jaccard_join"](spark, clean, SF).cache()
    ids = sorted(before)
    want = components(ids, sets_of([before[k] for k in ids], 5), 80)
    assert {r.doc_id for r in apart.collect()} == set(want.values()) and apart.columns == columns

    before = {r.doc_id: r.text for r in apart.collect()}
    cut = stages["suffix_array_dedup"](spark, apart, SF).cache()
    ids = sorted(before)
    after = {r.doc_id: r for r in cut.collect()}
    assert sorted(after) == ids and cut.columns == columns
    for k, gone in zip(ids, covered([before[k].encode() for k in ids], 200), strict=True):
        kept = bytes(b for b, g in zip(before[k].encode(), gone, strict=True) if not g).decode("utf-8", "ignore")
        assert after[k].text == kept and after[k].n_chars == len(kept)

    masked = stages["pii"](spark, cut, SF).cache()
    assert sorted(r.doc_id for r in masked.collect()) == ids and masked.columns == columns
    assert not any(base(r.text) for r in masked.collect())
    assert all(re.search(PLAIN["email"], r.text) is None for r in masked.collect())

    pieces = stages["packing"](spark, masked, SF).collect()
    assert {r.doc_id for r in pieces} == set(ids)
    for k in ids:
        own = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_stages_on_odd_tables(spark):
    """Nulls, empty texts, repeated rows and an extra column go through every stage; so does a table without rows."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructField, StructType

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("t1", F.lit("x"))
    docs = spark.createDataFrame([], StructType([StructField(f.name, f.dataType, True) for f in docs.schema]))
    long = " ".join(f"w{k}" for k in range(80))
    fill = {"doc_id": None, "text": None, "n_chars": None}
    rows = [{**fill, "doc_id": 1, "text": long}, {**fill, "doc_id": 1, "text": long}, {**fill, "doc_id": 2}, {**fill, "text": "mail a.b@example.org"}, {**fill, "doc_id": 3, "text": ""}, fill]
    odd = spark.createDataFrame([tuple(r.get(c) for c in docs.columns) for r in rows], docs.schema)
    few = [spark.createDataFrame([tuple({**fill, "doc_id": 1, "text": " ".join("abc"[:k])}.get(c) for c in docs.columns)], docs.schema) for k in (1, 2, 3)]
    for table, n in ((odd, len(rows)), (docs, 0), *((t, 1) for t in few)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if name != "packing":
                assert now.columns == docs.columns
            if name in ("toxicity", "ngram_jaccard_join"):
                assert now.count() == n
        assert (now.count() > 0) == (n > 0)
