"""Personal data: expressions propose spans, checks confirm them, context words adjust the score.

The four base kinds (email, ip, card, phone) keep every match that passes its own check.  The
further kinds (iban, ssn, account, key, secret) need a score of at least ``THRESHOLD``: a checksum, a fixed prefix or
a string that looks drawn at random gives a part of it, words such as "iban", "account" or "password" shortly
before the span add to it, words such as "order" take away.  Offsets are code points, the end exclusive.

Cases: a null text counts as empty; empty texts have no spans; very long texts are scanned whole in
linear time (runs are taken possessively, an address is found from its "@" backwards); repeated rows
get equal results; an empty table gives an empty result.  Other columns are kept; one that is called ``pii`` or ``pii_redacted`` is
replaced by the new one (the pipeline renames such columns before and after).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_at_a_time, small_batches, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "account", "key", "secret")
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Nothing can match from inside a run of digits if nothing matches from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{8,12}(?![0-9A-Za-z.-])")
# An access key of a fixed form, and strings that may be drawn at random.
_KEY = re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-zA-Z]+")

#: How far before a span context words are looked for, in code points.
REACH = 48
_FOR = {
    "email": frozenset({"mail", "email", "contact", "write"}),
    "ip": frozenset({"ip", "host", "address", "server"}),
    "card": frozenset({"card", "visa", "mastercard", "credit", "payment"}),
    "phone": frozenset({"phone", "tel", "telephone", "call", "mobile", "fax"}),
    "iban": frozenset({"iban", "account", "bank", "transfer", "konto"}),
    "ssn": frozenset({"ssn", "social", "security"}),
    "account": frozenset({"account", "acct", "konto", "passport", "license", "cuenta", "compte"}),
    "key": frozenset({"key", "access", "aws"}),
    "secret": frozenset({"password", "passwd", "pwd", "secret", "token", "key", "apikey", "bearer", "auth"}),
}
_AGAINST = frozenset({"version", "order", "invoice", "part", "isbn", "ticket", "example"})
_START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.35, "account": 0.2, "key": 0.6, "secret": 0.2}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN without spaces: moved to the end, letters as numbers, remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def _card_ok(s: str) -> bool:
    return 13 <= len(d := _digits(s)) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _iban_ok(s: str) -> bool:
    return 15 <= len(x := s.replace(" ", "")) <= 34 and mod97(x)


def _ssn_ok(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def _secret_ok(s: str) -> bool:
    """Letters and digits in turn, as drawn at random: at least 2.5 bits for each character, and no word with a number."""
    if len(s) > 512 or s.isdigit() or s.isalpha():
        return False
    turns = sum(a.isdigit() != b.isdigit() for a, b in itertools.pairwise(s))
    bits = -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
    return turns >= 3 and bits >= 2.5


def _score(kind: str, text: str, start: int) -> float:
    before = {w.lower() for w in _WORD.findall(text, max(0, start - REACH), start)}
    score = _START[kind] + 0.4 * bool(before & _FOR[kind]) - 0.3 * bool(before & _AGAINST)
    return min(1.0, max(0.0, round(score, 3)))


_TRIES = (("ip", _IP, _ip_ok), ("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok), ("iban", _IBAN, _iban_ok), ("ssn", _SSN, _ssn_ok), ("account", _ACCOUNT, lambda s: True), ("key", _KEY, lambda s: True), ("secret", _SECRET, _secret_ok))


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind as listed, then by start."""
    text = text or ""
    out = [Span("email", a, b, _score("email", text, a)) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for kind, pattern, check in _TRIES:
        for m in pattern.finditer(text):
            if check(m.group()):
                s = Span(kind, m.start(), m.end(), _score(kind, text, m.start()))
                if kind in BASE_KINDS or s.score >= THRESHOLD:
                    out.append(s)
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    if text is None or not spans:
        return text
    out, at, end, name = [], 0, -1, ""
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= end:
            if end >= 0:
                out.append(f"[{name}]")
                at = end
            out.append(text[at : s.start])
            name = s.kind.upper()
        end = max(end, s.end)
    out += [f"[{name}]", text[end:]]
    return "".join(out)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def with_spans(df: DataFrame, column: str = "text") -> DataFrame:
    """Add ``pii`` (the spans) and ``pii_redacted`` (the text without them) to each row."""
    names = [c for c in df.columns if c not in ("pii", "pii_redacted")]
    small_batches(df.sparkSession)
    df = df.select(*names)

    def run(batches):
        for b in few_at_a_time(batches, names.index(column)):
            texts = b.column(names.index(column)).to_pylist()
            spans = [find_spans(t) for t in texts]
            clean = [redact(t, s) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[x._asdict() for x in s] for s in spans], _SPANS), pa.array(clean, pa.string())], names=[*names, "pii", "pii_redacted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, pii {_SPANS_SQL}, pii_redacted string")


def summaries(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document: counts by base kind, digest of the base spans, list of all spans and of their scores."""
    small_batches(df.sparkSession)
    df = df.select(F.col(id_column), text_of(df).alias("text"))

    def run(batches):
        for b in few_at_a_time(batches, 1):
            found = [find_spans(t) for t in b.column(1).to_pylist()]
            base = [[s for s in x if s.kind in BASE_KINDS] for x in found]
            counts = [pa.array([sum(s.kind == k for s in x) for x in base], pa.int64()) for k in BASE_KINDS]
            sha = [hashlib.sha256(listed(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha, pa.string()), pa.array([listed(x) for x in found], pa.string()), pa.array([",".join(f"{s.score:.2f}" for s in x) for x in found], pa.string())], names=[id_column, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.mapInArrow(run, f"`{id_column}` {kind}, {', '.join(f'n_{k} bigint' for k in BASE_KINDS)}, base_sha256 string, spans string, scores string")
