"""Extraction of records from texts by pluggable extractors, with retries and fallbacks row by row.

An extractor has a name and complete(text) -> dict; it raises Transient where another try may help, and any other
error where none will. A row that one extractor cannot do goes to the next; one that none can do keeps the last
error and has no payload. Nothing fails but rows: a stage of a million texts is not lost for one.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ERROR = 2000


class Transient(Exception):
    """A failure that may pass: a timeout, a busy service."""


class Extractor(Protocol):
    name: str

    def complete(self, text: str) -> dict: ...


class PatternExtractor:
    """A deterministic extractor: the first match of each field's pattern (its first group, if it has one).
    Fields without a match are left out; without any, or without one of `required`, the text is refused."""

    def __init__(self, name: str, fields: dict[str, str], required: tuple[str, ...] = ()):
        self.name, self.required = name, required
        self.fields = {k: re.compile(p) for k, p in fields.items()}

    def complete(self, text: str) -> dict:
        found = {k: m[1] if m.re.groups else m[0] for k, p in self.fields.items() if (m := p.search(text))}
        missing = [r for r in self.required if r not in found]
        if missing or not found:
            raise ValueError(f"no {', '.join(missing or self.fields)}")
        return found


def extracted(texts: DataFrame, extractors: list[Extractor], tries: int = 3, backoff: float = 1.0) -> DataFrame:
    """(id, payload, extractor, attempts, error) of texts(id, text): payload is JSON, attempts count all calls.
    A transient failure is tried again after backoff, 2 * backoff, ... seconds. Null texts are empty ones."""

    def one(text: str) -> tuple[str | None, str | None, int, str | None]:
        attempts, error = 0, None
        for e in extractors:
            for k in range(tries):
                attempts += 1
                try:
                    return json.dumps(e.complete(text), ensure_ascii=False, sort_keys=True), e.name, attempts, None
                except Transient as x:
                    error = f"{e.name}: {type(x).__name__}: {x}"
                    if k + 1 < tries:
                        time.sleep(backoff * 2**k)
                except Exception as x:  # noqa: BLE001 a row's failure is the row's
                    error = f"{e.name}: {type(x).__name__}: {x}"
                    break
        return None, None, attempts, (error or "no extractor")[:MOST_ERROR]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [one(t) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "payload", "extractor", "attempts", "error"])

    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, payload string, extractor string, attempts int, error string")
