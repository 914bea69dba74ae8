"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping by kind; a match that fails its
check is dropped and not tried again from a later start. A base span always stays; its score only says how sure it is.
Further kinds must reach ``threshold`` by their own score plus what context words add: iban (mod-97 confirms) and ssn
(only with a context word near). Spans are code points, end exclusive.

The patterns take runs possessively from a run's start, so that long runs of digits or letters cost linear time; the
matches are those of the plain patterns.

Edge cases: a null text counts as empty and has no spans; nulls in other columns pass; repeated rows are scanned each;
whole texts are scanned, whatever their length. Extra columns are passed on; one that clashes with an output column is
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm.common import slices, tune

BASE = ("email", "ip", "card", "phone")
#: The patterns of the base kinds.
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_NEXT = re.compile(rf"{LOCAL}++@{DOMAIN}")
EMAIL = re.compile(rf"(?<!{LOCAL}){LOCAL}++@{DOMAIN}")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]")
DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class PiiConfig:
    threshold: float = 0.5
    window: int = 40
    own: dict[str, float] = field(default_factory=lambda: {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3})
    for_it: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "email": ("mail", "contact", "correo", "courriel"),
            "ip": ("ip", "host", "server", "address", "adresse"),
            "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
            "phone": ("phone", "call", "tel", "fax", "mobile", "telefon", "téléphone", "teléfono"),
            "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
            "ssn": ("ssn", "social", "security"),
        }
    )
    against: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"ip": ("version", "release"), "card": ("order", "isbn", "serial"), "ssn": ("part", "model")})


def luhn(digits: str) -> bool:
    """The Luhn checksum of a string of digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The ISO 13616 check: the country and check digits go to the end, letters count from 10."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, found = 0, EMAIL.search(text)
    while found:
        yield found.span()
        at = found.end()
        found = EMAIL_NEXT.match(text, at) or EMAIL.search(text, at)  # after a match a run may go on


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, before context is looked at."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0]):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        yield "ssn", *m.span()


def spans(text: str, cfg: PiiConfig = PiiConfig()) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed."""
    rank = {k: n for n, k in enumerate(cfg.own)}
    out = []
    for kind, s, e in proposals(text):
        score = cfg.own[kind]
        near = set(re.findall(r"[^\W\d_]+", f"{text[max(0, s - cfg.window) : s]} {text[e : e + cfg.window]}".lower()))
        score += 0.2 * any(w in near for w in cfg.for_it.get(kind, ())) - 0.2 * any(w in near for w in cfg.against.get(kind, ()))
        if kind in BASE or score >= cfg.threshold:
            out.append((s, e, kind, round(min(1.0, max(0.0, score)), 3)))
    return sorted(out, key=lambda x: (x[0], rank[x[2]]))


def masked(text: str, found: list[tuple[int, int, str, float]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts, and what it leaves goes too."""
    parts, at = [], 0
    for s, e, kind, _ in found:
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _added(documents: DataFrame, fields: list[T.StructField], fn) -> DataFrame:
    tune(documents.sparkSession)
    documents = documents.drop(*[f.name for f in fields if f.name != "text"])
    replaced = [f.name for f in fields]
    schema = T.StructType([*(f for f in documents.schema.fields if f.name not in replaced), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [fn(x or "") for x in part.column(part.schema.get_field_index("text")).to_pylist()]
                keep = [k for k, n in enumerate(part.schema.names) if n not in replaced]
                new = [pa.array([r[k] for r in rows], type=_ARROW[f.dataType.simpleString()]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *new], names=schema.names)

    return documents.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "array<struct<start:bigint,end:bigint,kind:string,score:double>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])),
}


def find(documents: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """The documents with ``pii``: an array of (start, end, kind, score)."""
    field = T.StructField("pii", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])))
    return _added(documents, [field], lambda text: ([dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in spans(text, config)],))


def redact(documents: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """The documents with every span of ``text`` replaced by its kind; a null text becomes an empty one."""
    return _added(documents, [T.StructField("text", T.StringType())], lambda text: (masked(text, spans(text, config)),)).select(*documents.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.common import table

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def digest(found: list[tuple[int, int, str, float]]) -> str:
    """What ``base_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k, _ in found if k in BASE).encode()).hexdigest()
