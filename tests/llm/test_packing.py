import zlib

import numpy as np
import pytest

from tesselar.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_cuts_cover_every_length():
    table = packing.cuts(2048)
    assert all(sum(x) == n for n, x in enumerate(table))
    assert max(map(len, table)) <= 8


def check(rows, texts):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(2048 if (n := sum(r.length for r in x)) & (n - 1) else n for x in by_seq.values())
    assert used <= 1.03 * sum(r.length for r in rows) + 4096
    for doc, text in texts:
        ids = whole(text)
        own = sorted((r for r in by_doc[doc, len(ids)]), key=lambda r: r.start)
        copies = sum(d == doc and t == text for d, t in texts)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_pack(spark):
    rng = np.random.default_rng(3)
    texts = [(k, " ".join("w" + str(int(x)) for x in rng.integers(0, 5000, int(n)))) for k, n in enumerate(rng.integers(0, 3000, 60))]
    texts += [(100, None), (101, ""), (102, "don't  <|endoftext|> É x y 'S naïve"), (103, "a"), (103, "a")]
    df = spark.createDataFrame([(*x, "t") for x in texts], "doc_id long, text string, length string")
    check(packing.pack(df, packing.PackConfig(PATH)).collect(), texts)
    assert packing.pack(df.limit(0), packing.PackConfig(PATH)).count() == 0


def test_query(spark):
    rows = packing.op8_packing(spark, "/root/testdata/sf0.001").collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:40])


def test_texts_beyond_a_step_and_other_tokenizers(spark, tmp_path):
    rng = np.random.default_rng(6)
    texts = [(1, " ".join("w" + str(int(x)) for x in rng.integers(0, 3000, 900_000))), (2, "short")]
    assert len(texts[0][1]) > packing.STEP
    check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), packing.PackConfig(PATH)).collect(), texts)
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "Ġ": 3}, []))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        packing._tokenizer(str(tmp_path / "other.json"))
