"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Kinds, in the order used for ties: ``email ip card phone`` (the base kinds),
then ``iban ssn secret``. A base span stands as soon as its validator accepts
it; words near it only move its score. An ``iban`` must pass mod-97. An ``ssn``
or ``secret`` has no checksum, so it needs a context word on either side of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernstone.llm.shared import small_batches
from quernstone.llm.textvec import slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

_LOCAL_CHAR = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from the others too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}(?![A-Za-z0-9])")
#: A fixed prefix that marks a key by itself.
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")

#: Whole words that make a span of a kind likelier, sought among the 32 characters before and after it.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "key", "apikey", "secret", "password"),
}
_NEAR = 32
_NEAR_WORDS = {kind: re.compile(rf"(?<![A-Za-z])(?:{'|'.join(words)})(?![A-Za-z])", re.I | re.A) for kind, words in CONTEXT.items()}
#: Score of a validated span without context, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.4}
CONTEXT_GAIN = 0.3
THRESHOLD = 0.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outward so that no text takes quadratic time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = after = m.end()
        at = text.find("@", after)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and checksum agree, kind by kind."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m.group()):
            yield "iban", m.start(), m.end()
    for kind, pattern in (("ssn", _SSN), ("secret", _SECRET), ("secret", _KEY_ID)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _context(kind: str, text: str, start: int, end: int) -> bool:
    # One more character on each side shows whether a word goes on there.
    before, after = text[max(0, start - _NEAR - 1) : start], text[end : end + _NEAR + 1]
    words = _NEAR_WORDS[kind]
    near = any(m.start() > 0 or start <= _NEAR for m in words.finditer(before)) or any(m.end() <= _NEAR for m in words.finditer(after))
    return near or kind == "secret" and text.startswith("AKIA", start)


def find(text: str | None) -> list[Span]:
    """All spans of a text (null: none), by start, then kind."""
    found = []
    for kind, a, b in propose(text or ""):
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * _context(kind, text, a, b))
        if kind in BASE or score >= THRESHOLD:
            found.append(Span(kind, a, b, score))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by ``[KIND]``."""
    if not spans:
        return text
    out, done = [], 0
    for s in spans:
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def with_spans(df: DataFrame, text: str = "text", spans: str = "pii_spans", redacted: str | None = None) -> DataFrame:
    """``df`` with its spans and, if ``redacted`` names a column, the text without them.

    A column of ``df`` that has one of these names is replaced. Null text has an
    empty list and stays null; rows are neither dropped nor merged. Narrow: no
    shuffle, one Arrow batch in memory at a time.
    """
    small_batches(df.sparkSession)
    names = [n for n in df.columns if n not in {spans, redacted} or n == text]
    kept = df.select(*[df[f"`{n}`"] for n in names])
    fields = [f for f in kept.schema.fields if f.name != redacted] + [T.StructField(spans, SPANS)]
    fields += [T.StructField(redacted, T.StringType())] if redacted else []
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in slices(batches):
            texts = b.column(names.index(text)).to_pylist()
            all_spans = [find(t) for t in texts]
            made = {spans: [[s.__dict__ for s in x] for x in all_spans]}
            if redacted:
                made[redacted] = [redact(t, x) for t, x in zip(texts, all_spans, strict=True)]
            cols = [pa.array(made[f.name], arrow.field(f.name).type) if f.name in made else b.column(names.index(f.name)).cast(arrow.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return kept.mapInArrow(run, schema)


def digest_rows(df: DataFrame) -> DataFrame:
    """Counts, digest and joined spans of every row of ``df(doc_id, text)``.

    Null text counts as empty: no spans, the digest of nothing, a null ``max_score``.
    Repeated rows are described one by one; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [find(t) for t in b.column(1).to_pylist()]
            base = [[s for s in r if s.kind in BASE] for r in rows]
            counts = {f"n_{k}": pa.array([sum(s.kind == k for s in r) for r in base], pa.int64()) for k in BASE}
            sha = [hashlib.sha256(joined(r).encode()).hexdigest() for r in base]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), **counts, "base_sha256": pa.array(sha, pa.string()), "spans": pa.array([joined(r) for r in rows], pa.string()), "max_score": pa.array([max((s.score for s in r), default=None) for r in rows], pa.float64())})

    small_batches(df.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, max_score double"
    return df.select("doc_id", "text").mapInArrow(run, schema)
