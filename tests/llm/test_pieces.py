import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


SP = library()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abeinortsth  \n\té▁漢🙂.,'19", max_size=40), min_size=1, max_size=5))
def test_ids_are_those_of_the_library(texts):
    texts = [t.replace("▁", " ") for t in texts]
    got = pieces.encode(texts, PATH)
    assert [x.tolist() for x in got] == SP.encode(texts)
    assert [pieces.decode(x, PATH) for x in got] == texts


def test_zero_and_odd_characters():
    for t in ("a\0b", "\0", "́x", "x" * 5000, " " * 300, "\n\n a"):
        got = pieces.encode([t], PATH)[0]
        assert pieces.decode(got, PATH) == t
        if "\0" not in t:
            assert got.tolist() == SP.encode(t)


def test_cache_may_fill(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 20)
    for k in range(6):
        texts = [f"word{k} other{j} the {j}" for j in range(8)]
        assert [x.tolist() for x in pieces.encode(texts, PATH)] == SP.encode(texts)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pieces.op6_pieces(spark, sf).collect():
        ids = SP.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (None, "", 3)], "doc_id long, text string, ids int")
    got = pieces.decoded(pieces.encoded(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in got) == ["", "", "a b"]
    assert pieces.encoded(df.limit(0), PATH).count() == 0


def test_a_megabyte_without_spaces():
    letters = "abcdefghijklmnopqrstuvwxyz"
    state = np.random.default_rng(5).integers(0, 26, 1_000_000)
    t = "".join(map(letters.__getitem__, state.tolist()))
    assert pieces.encode([t], PATH)[0].tolist() == SP.encode(t)
    for t in ("ab" * 300, "é漢" * 200 + "the" * 90, "x" * 129, "\0" * 200 + "abc" * 50):
        assert pieces.decode(pieces.encode([t], PATH)[0], PATH) == t
        if "\0" not in t:
            assert pieces.encode([t], PATH)[0].tolist() == SP.encode(t)
