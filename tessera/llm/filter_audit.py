"""Which filter takes which documents, in every order in which five filters can be applied.

Filters. A: under 100 words; B: fewer than 80 distinct words in 100; C: over 10 capitals A-Z in
100 code points; D: holds one of #$%&*|; E: the text of a smaller doc_id, anywhere in the table.
Words are maximal runs of characters other than space and \\t to \\r, and keep their case.

1. Scan. Arrow's string buffers are read as byte arrays. A table of byte classes turns them into
   flags, whose prefix sums, taken at the texts' borders, count code points, capitals and symbols
   of all texts of a batch at once. Words are hashed; sorted by (document, hash), words that are
   equal are neighbours. Neighbours of one hash are compared byte by byte; a document in which two
   that differ share a hash is counted word by word. So the distinct counts are exact.
2. Copies. The scan leaves a SHA-256 digest of each text; the smallest doc_id of each digest, made
   by partial aggregation, is joined back on (doc_id, digest), so a group of copies of any size is
   dealt over all tasks.
3. Reduction. Documents become counts by (part, mask of failed filters, quality, toxicity): at most
   128 rows a part, from which all 120 orders follow.

Null text is the empty text (it fails A, and E if another is empty); a text without words does not
fail B, one without code points not C. A null doc_id is no smaller id and has none. Rows that share
id and text are copies of nobody. A document is good (toxic) if any of its label rows says so; rows
without id or label are neither. Very long texts are scanned in blocks. An empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ragged
from tessera.llm.shared import text_rows, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
BLOCK = 1 << 20

_CHARACTER = np.zeros(256, np.uint8)  # the first byte of a code point
_CHARACTER[:0x80], _CHARACTER[0xC0:] = 1, 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[ord("A") : ord("Z") + 1] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#$%&*|")] = 1
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def counted(kind: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are of a class: differences of prefix sums, a block at a time."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo in range(0, len(data), BLOCK):
        sums = np.r_[0, np.cumsum(kind[data[lo : lo + BLOCK]], dtype=np.int64)]
        at = sums[np.clip(offsets - lo, 0, len(sums) - 1)]
        out += at[1:] - at[:-1]
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, a block of words at a time."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        out[i:j] = ragged.span_hash(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    """The number of distinct words of each of n texts."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1]))
    a, b = order[same], order[same + 1]
    size = ends - starts
    wrong = size[a] != size[b]
    fit = np.flatnonzero(~wrong)
    i = 0
    total = np.cumsum(size[a[fit]])
    while i < len(fit):  # byte by byte, a block at a time
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, "right")))
        x, y = a[fit[i:j]], b[fit[i:j]]
        unequal = data[ragged.concat_spans(starts[x], ends[x])] != data[ragged.concat_spans(starts[y], ends[y])]
        if unequal.any():
            wrong[fit[i:j]] |= np.logical_or.reduceat(unequal, np.cumsum(size[x]) - size[x])
        i = j
    out = np.bincount(rows, minlength=n) - np.bincount(r[same], minlength=n)
    for k in np.unique(r[same[wrong]]).tolist():
        own = np.flatnonzero(rows == k)
        out[k] = len({data[starts[w] : ends[w]].tobytes() for w in own})
    return out


def scanned(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mask of the filters A to D that each text fails."""
    n = len(offsets) - 1
    starts, ends = ragged.runs(_WORD[data], offsets)
    rows = ragged.rows_of(starts, offsets)
    words = np.bincount(rows, minlength=n)
    distinct = distinct_words(data, starts, ends, rows, n, word_hashes(data, starts, ends))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * counted(_CAPITAL, data, offsets) > MOST_CAPITALS * counted(_CHARACTER, data, offsets), counted(_SYMBOL, data, offsets) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def failed_filters(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every row: bit k of mask is set if the text fails filter "ABCDE"[k]."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, data, offsets in ragged.slices(b.column(1), BLOCK):
                raw = memoryview(np.ascontiguousarray(data))
                digests = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(scanned(data, offsets), pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    rows = text_rows(documents, id_col, text_col, F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = written(rows.mapInArrow(ragged.tidy(batches), f"id {kind}, part string, mask int, digest binary"), "scanned")
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["id", "digest"], "left").select("id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))).otherwise(F.col("mask")).alias("mask"))


def orders() -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    out = []
    for p in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(p):
            out.append({"filter_order": "".join(p), "step": k + 1, "bit": 1 << FILTERS.index(f), "before": before})
            before |= 1 << FILTERS.index(f)
    return out


def audit(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, from failed_filters() and labels(doc_id, quality, toxic).

    kept and removed count documents after and at the step, redundant those that fail its filter but went
    before, unique_fails those that fail nothing else, good_lost and toxic_lost the removed ones labelled so.
    shapley sums what the filter removes over all orders: a document that fails m filters falls to each of
    them in 120 / m orders."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.expr("CASE WHEN quality = 1 THEN 1 ELSE 0 END")).alias("good"), F.max(F.expr("CASE WHEN toxic = 1 THEN 1 ELSE 0 END")).alias("toxic"))
    cells = failures.join(told, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 masks at most
    plan = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    steps = parts.select("part", "cells", F.explode(plan).alias("p")).select("part", "cells", "p.*")
    total = lambda value, when: F.expr(f"aggregate(cells, 0L, (t, c) -> t + CASE WHEN {when} THEN {value} ELSE 0L END)")
    removed = "(c.mask & bit) <> 0 AND (c.mask & before) = 0"
    return steps.select(
        "part", "filter_order", "step", total("c.n", "(c.mask & (bit | before)) = 0").alias("kept"), total("c.n", removed).alias("removed"),
        total("c.n", "(c.mask & bit) <> 0 AND (c.mask & before) <> 0").alias("redundant"), total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.good", removed).alias("good_lost"), total("c.toxic", removed).alias("toxic_lost"), total("c.n * CAST(120 / bit_count(c.mask) AS BIGINT)", "(c.mask & bit) <> 0").alias("shapley"),
    )


def duckdb_sql() -> str:
    """The same over the views documents and labels."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
f AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) r(k))
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
 coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM s, c GROUP BY part, filter_order, step, bit, before"""
