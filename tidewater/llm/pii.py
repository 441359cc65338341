"""Operator 6: personal data by pattern, checksum validator and context score.

A pattern proposes spans, a validator (octet range, Luhn, mod-97, digit count)
confirms them, and words within ``CONTEXT_CHARS`` before or after raise or lower
the score.  Four base kinds (email, ip, card, phone) are reported whenever their
validator holds; the kinds the method adds (iban, short cards, phones without a
country code, national ids) need a score of ``MIN_SCORE``, which a bare number
only reaches next to a fitting word (English, and some German, French and Spanish ones).  Added spans never overlap base spans.

Where the longest form of an account number fails its checksum, shorter ones that end at
a space of the proposal are tried, since a word in capitals may follow the number.

Patterns scan a text once: matches start only where a run of their characters
starts, which gives the same leftmost spans in linear time on very long runs.

Results: null text counts as empty (no spans, the digest of the empty string).
Repeated rows and null ids are kept, one output row each.  Only the id and text
columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import map_batches

# The base kinds in their listed order, then the kinds this operator adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "card_short", "phone_local", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS

MIN_SCORE = 0.5
CONTEXT_CHARS = 40

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])")
NATIONAL_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
NOT_DIGIT = re.compile(r"[^0-9]+")

RAISING = {
    "iban": re.compile(r"\b(?:iban|account|konto|cuenta|compte)\b", re.I),
    "card_short": re.compile(r"\b(?:card|credit|debit|visa|amex|karte|carte|tarjeta)\b", re.I),
    "phone_local": re.compile(r"\b(?:phone|tel|telefon|call|mobile|fax|tél|teléfono)\b", re.I),
    "national_id": re.compile(r"\b(?:ssn|social security|national id|tax id)\b", re.I),
}
LOWERING = re.compile(r"\b(?:version|isbn|order|invoice|serial|part|sku|page|figure|table|sha\d*|token)\b", re.I)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    rest = 0
    for ch in s[4:] + s[:4]:
        v = int(ch, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the longest free run of local characters before it."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > pos and text[s - 1] in LOCAL_CHARS:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = text.find("@", pos)
    return out


def base_spans(text: str) -> list[Span]:
    out = [Span("email", s, e, 0.95) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m.group().split(".")):
            out.append(Span("ip", m.start(), m.end(), 0.8))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", m.start(), m.end(), 0.9))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(Span("phone", m.start(), m.end(), 0.8))
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Non-overlapping account numbers: of each proposal the longest form, ending at a space or its end, that holds.

    A proposal that fails may hold another one, so the search goes on at its next group.
    """
    out, m = [], IBAN.search(text)
    while m:
        s, e = m.span()
        spaces = [i for i in range(s, e) if text[i] == " "]
        end = next((x for x in (e, *reversed(spaces))
                    if 15 <= len(text[s:x].replace(" ", "")) <= 34 and mod97(text[s:x])), None)
        if end is not None:
            out.append((s, end))
        m = IBAN.search(text, end if end is not None else spaces[0] if spaces else e)
    return out


def _proposals(text: str):
    """Kind, start, end, score before context; only confirmed proposals."""
    for s, e in ibans(text):
        yield "iban", s, e, 0.8
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 31:
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 15 and luhn(digits):
                yield "card_short", *m.span(), 0.3
    for m in LOCAL_PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 12:
            yield "phone_local", *m.span(), 0.3
    for m in NATIONAL_ID.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000":
            yield "national_id", *m.span(), 0.4


def _merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that the spans cover, ascending."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind as listed, then start."""
    if not text:
        return []
    out = base_spans(text)
    starts, ends = _merged((s.start, s.end) for s in out)
    added: list[Span] = []
    for kind, start, end, score in _proposals(text):
        near = text[max(0, start - CONTEXT_CHARS):start] + " \n " + text[end:end + CONTEXT_CHARS]
        if RAISING[kind].search(near):
            score += 0.4
        if LOWERING.search(near):
            score -= 0.2
        if score >= MIN_SCORE:
            added.append(Span(kind, start, end, round(score, 2)))
    for sp in added:  # an earlier kind wins where two overlap
        at = bisect_left(starts, sp.end)  # of the taken intervals that start before its end, the last one reaches furthest
        if not at or ends[at - 1] <= sp.start:
            out.append(sp)
            starts.insert(at, sp.start)
            ends.insert(at, sp.end)
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in capitals, as in <EMAIL>; overlaps merge under the first kind."""
    spans = sorted(find_spans(text), key=lambda s: (s.start, -s.end))
    if not spans:
        return text
    out, pos = [], 0
    for s in spans:
        if s.start >= pos:
            out += [text[pos:s.start], f"<{s.kind.upper()}>"]
        pos = max(pos, s.end)
    return "".join(out) + text[pos:]


def _join(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and found, an array of (kind, start, end, score); code points, end exclusive."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        found = [[s._asdict() for s in find_spans(t)] for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "found": found}

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run,
                       f"doc_id {id_type}, found array<struct<kind:string,start:int,end:int,score:double>>")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the count of each base kind, the digest of the base spans, all spans as one string."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for t in batch.column(1).to_pylist():
            spans = find_spans(t)
            base = [s for s in spans if s.kind in BASE_KINDS]
            for k in BASE_KINDS:
                cols[f"n_{k}"].append(sum(s.kind == k for s in base))
            cols["base_sha256"].append(hashlib.sha256(_join(base).encode()).hexdigest())
            cols["spans"].append(_join(spans))
        return {"doc_id": batch.column(0)} | cols

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run,
                       f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind; ``length_col`` is set to the new code points."""
    at = docs.columns.index(text_col)
    lengths = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batch: pa.RecordBatch) -> dict:
        out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        texts = [mask(t) for t in batch.column(at).to_pylist()]
        out[text_col] = pa.array(texts, batch.schema.field(at).type)
        if lengths is not None:
            out[length_col] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(lengths).type)
        return out

    return map_batches(docs, run, docs.schema)
