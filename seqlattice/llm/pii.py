"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import text_rows

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Spans of the added kinds stay from this score on; those of the base kinds always stay.
KEEP_SCORE = 0.5
#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 40

# Possessive forms of the base patterns: a failing match can't be mended inside the same run of characters.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_/+=-]{20,}+")
_NOT_DIGIT = re.compile("[^0-9]+")

# Words that speak for a kind when they stand near a span.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password", "passwd", "api", "bearer", "credential"),
}
_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")(?![a-z])") for k, v in CONTEXT.items()}
#: Score of a confirmed span without context, and what a context word adds.
BASE_SCORE = {"email": 0.7, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.2}
CONTEXT_GAIN = 0.35


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


_GROUP = re.compile(r"[A-Z0-9]+")


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each candidate's longest part, up to the end of a group, that passes mod-97. The search goes on behind it, or behind the
    candidate's first group if no part passes."""
    m = _IBAN.search(text)
    while m:
        ends = [m.start() + g.end() for g in _GROUP.finditer(m[0])]
        end = next((e for e in reversed(ends) if mod97(text[m.start() : e])), 0)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or ends[0])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of the address pattern, found from each ``@`` outwards: a run of local characters is read once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in (q if len(q) < 20 else q.lstrip("0")[:20] or "0" for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _looks_random(value: str) -> bool:
    """A key-like string: letters and digits mixed, or long hexadecimal."""
    digits = sum(c.isdigit() for c in value)
    return digits >= 3 and len(value) - digits >= 3 and len(set(value)) >= 10


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    return min(1.0, BASE_SCORE[kind] + (CONTEXT_GAIN if _CONTEXT[kind].search(near) else 0.0))


class Taken:
    """Places that spans have taken, as intervals apart from each other in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, start: int, end: int) -> bool:
        return bisect_right(self.ends, start) == bisect_left(self.starts, end)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def find_spans(text: str, keep: float = KEEP_SCORE, base: list[tuple[str, int, int]] | None = None) -> list[Span]:
    """Base spans, and added spans that pass their check and reach ``keep``; added spans never overlap a base span or another."""
    base = base_spans(text) if base is None else base
    out = [Span(k, a, b, _score(text, k, a, b)) for k, a, b in base]
    taken = Taken([(a, b) for _, a, b in base])
    matched = lambda pattern, confirmed: (m.span() for m in pattern.finditer(text) if confirmed(m[0]))
    ssn = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    for kind, found in (("iban", ibans(text)), ("ssn", matched(_SSN, ssn)), ("secret", matched(_SECRET, _looks_random))):
        for start, end in found:
            if taken.free(start, end):
                score = _score(text, kind, start, end)
                if score >= keep:
                    out.append(Span(kind, start, end, score))
                    taken.add(start, end)
    return sorted(out, key=lambda s: (s.start, ORDER[s.kind]))


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double,value:string>>, base string"


def find_pii(docs: DataFrame, keep: float = KEEP_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, base): one row per document row. ``spans`` are all spans with score and text, ``base`` joins the base
    kinds' spans as kind:start:end. Offsets are code points, the end is exclusive.

    Null or empty text has no spans; rows that repeat are each answered; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, base = [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                mine = base_spans(text)
                found = find_spans(text, keep, mine)
                spans.append([s._asdict() | {"value": text[s.start : s.end]} for s in found])
                base.append(joined(mine))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind), pa.array(base, pa.string())], ["doc_id", "spans", "base"])

    return text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, keep: float = KEEP_SCORE, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by ``<KIND>``. Null texts stay null, empty ones empty; of spans that overlap
    the first is replaced; repeated rows are each answered; an empty table gives no rows."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value in b.column(text_col):
                text = value.as_py()
                done, parts = 0, []
                for s in find_spans(text, keep) if text else ():
                    if s.start >= done:
                        parts += [text[done : s.start], f"<{s.kind.upper()}>"]
                        done = s.end
                out.append(text if text is None else "".join(parts) + text[done:])
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and the two digests of the spans."""
    base = F.split("base", ",")
    count = lambda k: F.size(F.filter(base, lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:4]],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
    )

