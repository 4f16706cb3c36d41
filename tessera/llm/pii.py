"""Personal data: regular expressions propose spans, checksum validators confirm them, and
words near a span adjust its score.

Kinds in order: email, ip, card (Luhn), phone (digit count), iban (mod-97). Matching is
leftmost and non-overlapping within a kind over the whole text; a match that its validator
refuses is dropped and not tried again at another start. Offsets are code points, the end
exclusive. Every pattern runs in time linear in the text: runs are entered only at their
first character, and email matching starts from each @.

Null and empty texts have no spans; very long texts are scanned whole; spans of different kinds
may overlap, and each counts; repeated rows are scanned each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import ragged
from tessera.llm.shared import text_rows

# The patterns of the contract, the kinds in its order, and iban after them.
KINDS = ("email", "ip", "card", "phone", "iban")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
DIGIT = re.compile("[0-9]")
# Words that support a kind when they stand shortly before or after a span.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
NEAR, BOOST = 40, 0.1
_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(w) + ")", re.I) for k, w in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        elif start < at:
            end = max(end, at)  # the run before this @ has been seen; later runs begin after it
        at = text.find("@", max(at + 1, end))
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def _ibans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", a, b) for a, b in _ips(text)]
        out += [("card", a, b) for a, b in _cards(text)]
        if "+" in text:
            out += [("phone", a, b) for a, b in _phones(text)]
        out += [("iban", a, b) for a, b in _ibans(text)]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + "\n" + text[end : end + NEAR]
    return min(1.0, PRIOR[kind] + (BOOST if _CONTEXT[kind].search(near) else 0.0))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in find(text)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts of each kind, a digest of the four base kinds' spans, all
    spans, each with its score, and the highest score (0 where there is none)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts, digests, spans, scored, best = [[] for _ in KINDS], [], [], [], []
            for text in b.column(1):
                text = text.as_py()
                found = find(text)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(x[0] == kind for x in found))
                told = [f"{k}:{s}:{e}" for k, s, e in found]
                points = [score(text, *x) for x in found]
                digests.append(hashlib.sha256(",".join(x for x, f in zip(told, found, strict=True) if f[0] != "iban").encode()).hexdigest())
                spans.append(",".join(told))
                scored.append(",".join(f"{x}:{p:.2f}" for x, p in zip(told, points, strict=True)))
                best.append(max(points, default=0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(scored), pa.array(best, pa.float64())], NAMES)

    NAMES = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scored_spans", "score"]
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(ragged.tidy(batches), f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, scored_spans string, score double").withColumnRenamed("id", id_col)


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text column replaced; null stays null, other columns stay."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = pa.array([None if x is None else redact(x) for x in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([text if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(ragged.tidy(batches), schema)
