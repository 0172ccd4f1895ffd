"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Base kinds (email, ip, card, phone) are found leftmost and without overlap inside each kind; a match that fails its
check is dropped, and the search goes on behind it. A base span is kept whatever its score. Further kinds need a score
of KEEP: iban (confirmed by mod-97), phone_local and ssn (numbers without a country code, which words nearby must
support). Every search is linear in the text, runs of a million digits included. Positions are code points.

Cases: a null text is empty; an empty text has no spans; repeated rows give repeated results; a table without rows gives
none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from morpholake.llm.blocks import id_and_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "phone_local", "ssn")
#: Score of a span by its pattern and check alone.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "phone_local": 0.3, "ssn": 0.3}
KEEP, GAIN, LOSS, NEAR = 0.5, 0.3, 0.3, 48
#: Words that support a kind when they stand within NEAR characters before or behind a span.
SUPPORT = {
    "email": r"e-?mail|contact|write",
    "ip": r"ip|address|host|server",
    "card": r"card|visa|credit|debit|pay(?:ment)?",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "phone_local": r"phone|tel|call|mobile|fax",
    "ssn": r"ssn|social security",
}
#: Words that speak against a kind.
AGAINST = {"ip": r"version|release", "card": r"order|invoice|tracking", "iban": r"serial|product key", "phone_local": r"order|invoice|part", "ssn": r"order|invoice|part"}
_SUPPORT = {k: re.compile(rf"\b(?:{x})\b", re.IGNORECASE) for k, x in SUPPORT.items()}
_AGAINST = {k: re.compile(rf"\b(?:{x})\b", re.IGNORECASE) for k, x in AGAINST.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number (letters A-Z and digits, without spaces) leaves 1 on division by 97."""
    left = 0
    for c in code[4:] + code[:4]:
        left = (left * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return left == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        run = m[0]
        end = len(run)
        while not "0" <= run[end - 1] <= "9":
            end -= 1
        if end >= 4 and 9 <= sum("0" <= c <= "9" for c in run[:end]) <= 15:
            yield m.start(), m.start() + end


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield m.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_BASE = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}
_MORE = {"iban": _ibans, "phone_local": lambda text: (m.span() for m in _PHONE_LOCAL.finditer(text)), "ssn": _ssns}
_DIGIT = re.compile("[0-9]")


def find_spans(text: str) -> list[Span]:
    """All spans, by kind as in KINDS, then by start. Added spans never overlap base ones or earlier added ones."""
    digits = _DIGIT.search(text) is not None
    need = {"email": "@" in text, "phone": "+" in text}
    base = {kind: list(find(text)) if need.get(kind, digits) else [] for kind, find in _BASE.items()}
    out = [Span(kind, a, b, _score(kind, text, a, b)) for kind in BASE for a, b in base[kind]]
    more = [(kind, a, b, score) for kind, find in _MORE.items() if digits for a, b in find(text) if (score := _score(kind, text, a, b)) >= KEEP]
    if not more:
        return out
    covered = bytearray(len(text))
    for _, a, b, _ in out:
        covered[a:b] = b"\1" * (b - a)
    for kind, a, b, score in more:
        if not any(covered[a:b]):
            covered[a:b] = b"\1" * (b - a)
            out.append(Span(kind, a, b, score))
    return out


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - NEAR) : start]}\n{text[end : end + NEAR]}"
    score = SCORE[kind] + GAIN * bool(_SUPPORT[kind].search(near)) - LOSS * bool(kind in _AGAINST and _AGAINST[kind].search(near))
    return round(min(1.0, max(0.0, score)), 3)


def redact(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind in angle brackets; overlapping spans by the first one's."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>, redacted if asked for) for each row; no shuffle."""
    texts = id_and_text(df, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):  # short slices: texts are Python strings here
                part = batch.slice(i, 256)
                texts = part.column(1).to_pylist()
                found = [find_spans(t) for t in texts]
                columns = {"doc_id": part.column(0), "spans": pa.array([[s._asdict() for s in x] for x in found], pa.list_(span))}
                if redacted:
                    columns["redacted"] = pa.array([redact(t, x) if x else t for t, x in zip(texts, found, strict=True)])
                yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>" + ", redacted string" * redacted)



def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with its own columns, text redacted and (where there is such a column) its characters counted anew; no shuffle. A null text stays null."""
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [None if t is None else redact(t, find_spans(t)) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.types[at])
                if count_at is not None:
                    columns[count_at] = pa.array([None if t is None else len(t) for t in texts], part.schema.types[count_at])
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
