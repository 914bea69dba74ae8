import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tesselar.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for n, (kind, p) in enumerate(PLAIN.items()):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), n, kind, m.end()))
    return [(s, e, k) for s, _, k, e in sorted(out)]


def base(text):
    return [(s, e, k) for s, e, k, _ in pii.spans(text) if k in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@_-+%1259 ()é0", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "a@b.c", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (555) 555-0100", " ", ".", "-", "x", "é", "@"]), max_size=8))
def test_base_spans_of_pieces(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_added_kinds_and_context():
    iban = "pay to account GB82 WEST 1234 5698 7654 32 now"
    assert [k for *_, k, _ in pii.spans(iban)] == ["iban"]
    assert pii.spans(iban.replace("82", "83")) == []
    assert [k for *_, k, _ in pii.spans("my ssn is 123-45-6789")] == ["ssn"]
    assert pii.spans("code 123-45-6789") == []
    assert pii.masked("mail a@b.co now", pii.spans("mail a@b.co now")) == "mail <EMAIL> now"


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a." * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.spans(text)


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "a@b.co 10.0.0.1", "y"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = pii.find(df).collect()
    assert sorted(len(r.pii) for r in got) == [0, 0, 0, 2]
    assert pii.find(df.limit(0)).count() == 0
    assert sorted(r.text for r in pii.redact(df).collect()) == ["", "", "", "<EMAIL> <IP>"]
    assert pii.redact(df).columns == df.columns


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op2_pii(spark, sf).collect():
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in want) for x in pii.BASE]
        assert r.base_sha256 == pii.digest([(*x, 1.0) for x in want])
        assert [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE] == [f"{k}:{s}:{e}" for s, e, k in want]
