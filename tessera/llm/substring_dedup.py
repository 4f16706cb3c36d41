"""Removal of passages of LEAST words or more that stand earlier in the corpus, by suffix automata.

A window is LEAST consecutive words of one document. A word goes if a window that covers it stands
earlier too: in a smaller document, or further up in the same one. What is judged is the input.

Routing. One automaton of the whole corpus is no option, nor is every document against every shard
of it: that is documents x shards. Equal windows have equal words at equal places, hence the same
anchor: the smallest hash among the window's word KGRAM-grams. The windows of a document fall into
stretches, each the run of windows of one anchor (at most LEAST + LEAST - KGRAM words). Only anchors
that occur twice in the corpus go on, and all stretches of an anchor go to one shard.

Shards. Equal stretches of an anchor are streamed once, for the first of them; the others start
later in every window. A shard holds about SHARD words of such stretches, whatever the corpus, and
its automaton reaches, within that one task, all documents' stretches that can match: no shard is
sent to executors whose documents cannot. Stretches stream through it in order of their places.
Each is first matched, the matching statistic at a word being the length of the longest suffix that
earlier ones hold; where it is LEAST or more a window ends that stands earlier. Then it extends the
automaton. An anchor with more than HOT different stretches is dealt over shards by single windows,
and equal windows are pre-aggregated, so a passage in a third of all documents, or a phrase in as many
contexts, stays no larger than any other. The windows found, joined back to all stretches, are united
to maximal spans, which are taken out.

Words are compared by 64-bit hashes; a wrong removal needs 20 words of which one differs and
collides. Documents are ordered by id; null is the least id, rows that share an id are ordered by the
hash of their text, and rows that share both are one document, told again. Null and empty texts have
no words; very long ones are taken whole, in blocks. An empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ragged
from tessera.llm.filter_audit import word_hashes
from tessera.llm.shared import written

LEAST, KGRAM = 20, 8
STEPS = LEAST - KGRAM + 1  # the k-grams of a window; also the most windows of one stretch
SHARD = 50_000
HOT = 2_000
BLOCK = 1 << 20
PLACE = ["d", "th", "start"]

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_MIX = np.random.RandomState(90001).randint(0, 2**63, KGRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, where each text's words begin): the words of all texts as spans."""
    starts, ends = ragged.runs(_WORD[data], offsets)
    count = np.bincount(ragged.rows_of(starts, offsets), minlength=len(offsets) - 1) if len(starts) else np.zeros(len(offsets) - 1, np.int64)
    return starts, ends, np.r_[0, np.cumsum(count)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base)], dtype=np.uint64)


def stretch_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch words[start:end], by prefix sums of a polynomial."""
    lo, out = int(starts.min()) if len(starts) else 0, np.zeros(len(starts), np.uint64)
    hi = int(ends.max()) if len(ends) else 0
    sums = np.r_[np.uint64(0), np.cumsum(words[lo:hi] * _powers(_BASE, hi - lo)[:-1], dtype=np.uint64)]
    out = (sums[ends - lo] - sums[starts - lo]) * _powers(_UNBASE, hi - lo)[starts - lo]
    return ragged.mix(out + (ends - starts).astype(np.uint64) * _MIX[0])


def stretches(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, n, anchor, fingerprint) of every stretch of every text; start counts words of the text."""
    total = len(words)
    if total < LEAST:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = np.zeros(total - KGRAM + 1, np.uint64)
    for k in range(KGRAM):
        grams += words[k : total - KGRAM + 1 + k] * _MIX[k]
    grams = ragged.mix(grams)
    anchor = np.empty(total - LEAST + 1, np.int64)
    for lo in range(0, len(anchor), BLOCK):
        hi = min(lo + BLOCK, len(anchor))
        anchor[lo:hi] = np.lib.stride_tricks.sliding_window_view(grams[lo : hi + STEPS - 1], STEPS).argmin(1) + np.arange(lo, hi)
    sizes = np.diff(at)
    first = np.repeat(at[:-1], np.maximum(sizes - LEAST + 1, 0))
    begin = ragged.concat_spans(at[:-1], at[:-1] + np.maximum(sizes - LEAST + 1, 0))  # windows within one text
    if not len(begin):
        return stretches(words[:0], at)
    a = anchor[begin]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (first[1:] != first[:-1])])
    n = np.diff(np.r_[head, len(a)])
    start = begin[head]
    return np.searchsorted(at, start, "right") - 1, start - first[head], n, grams[a[head]], stretch_hashes(words, start, start + n + LEAST - 1)


class Automaton:
    """The suffix automaton of the sequences added so far."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def matched(self, sequence: list[int]) -> list[int]:
        """The matching statistics of a sequence: at each place the length of the longest suffix that
        stands in a sequence added before."""
        state, size, out = 0, 0, []
        length, link, after = self.length, self.link, self.next
        for c in sequence:
            while state and c not in after[state]:
                state = link[state]
                size = length[state]
            to = after[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for what reaches it from p and from p's suffixes."""
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        length, link, after = self.length, self.link, self.next
        for c in sequence:
            q = after[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            after.append({})
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new


def shard_masks(sequences: list[list[int]]) -> list[int]:
    """For sequences in order of their places: bit k is set if the window at k stands in an earlier one."""
    reference, out = Automaton(), []
    for s in sequences:
        sizes = reference.matched(s)
        out.append(sum(1 << k for k, size in enumerate(sizes[LEAST - 1 :]) if size >= LEAST))
        reference.add(s)
    return out


def _documents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d, th, text): d and th order the documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _anchored(docs: DataFrame) -> DataFrame:
    """(h, fp, d, th, start, n) of every stretch."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, data, offsets in ragged.slices(b.column(2), BLOCK):
                starts, ends, at = words_of(data, offsets)
                row, start, n, h, fp = stretches(word_hashes(data, starts, ends), at)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(fp), b.column(0).slice(lo, hi - lo).take(of), b.column(1).slice(lo, hi - lo).take(of), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "fp", "d", "th", "start", "n"])

    return docs.select("d", "th", "text").mapInArrow(ragged.tidy(batches), "h bigint, fp bigint, d bigint, th bigint, start int, n int")


def _sequences(wanted: DataFrame) -> DataFrame:
    """wanted(d, th, text, parts) -> a row (h, fp, bit, n, d, th, start, sid, words) for each stretch in parts
    (start, n, h, fp, split), or for each window of one that is to be split."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in range(b.num_rows):
                data, offsets = ragged.buffers(b.column(2).slice(row, 1))
                starts, ends, _ = words_of(data, offsets)
                words = word_hashes(data, starts, ends)
                parts = b.column(3)[row].values
                start, n, h, fp, split = (parts.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "h", "fp", "split"))
                bits = np.where(split, n, 1)
                of = np.repeat(np.arange(len(n)), bits)
                bit = np.arange(len(of)) - np.repeat(np.cumsum(bits) - bits, bits)
                begin, size = start[of] + bit, np.where(split, 1, n)[of]
                end = begin + size + LEAST - 1
                sid = np.where(split[of], stretch_hashes(words, begin, end).view(np.int64), fp[of])
                flat = words[ragged.concat_spans(begin.astype(np.int64), end.astype(np.int64))].view(np.uint8)
                borders = np.r_[0, np.cumsum(8 * (end - begin))].astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(flat))])
                same = lambda c: pa.repeat(b.column(c)[row], len(of))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(h[of]), pa.array(fp[of]), pa.array(bit.astype(np.int32)), pa.array(size.astype(np.int32)), same(0), same(1), pa.array(begin.astype(np.int32)), pa.array(sid), raw, pa.array(split[of])], ["h", "fp", "bit", "n", "d", "th", "start", "sid", "words", "split"])

    return wanted.select("d", "th", "text", "parts").mapInArrow(ragged.tidy(batches), "h bigint, fp bigint, bit int, n int, d bigint, th bigint, start int, sid bigint, words binary, split boolean")


def _shard(rows: pa.Table) -> pa.Table:
    """The masks of one shard's sequences; a sequence that is there twice, from a row told again, counts once."""
    rows = rows.sort_by([(c, "ascending") for c in PLACE])
    place = [rows.column(c).to_numpy() for c in PLACE]
    own = np.r_[True, np.any([c[1:] != c[:-1] for c in place], axis=0)] if rows.num_rows else np.zeros(0, bool)
    rows = rows.filter(pa.array(own))
    raw, borders = ragged.buffers(rows.column("words"))
    codes = np.unique(np.ascontiguousarray(raw).view(np.uint64), return_inverse=True)[1].tolist()
    cut = (borders // 8).tolist()
    masks = shard_masks([codes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return rows.select(["h", "fp", "sid", "split", *PLACE]).append_column("mask", pa.array(masks, pa.int32())).cast(pa.schema([("h", pa.int64()), ("fp", pa.int64()), ("sid", pa.int64()), ("split", pa.bool_()), ("d", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("mask", pa.int32())]))


def earlier_windows(docs: DataFrame) -> DataFrame:
    """(d, th, start, bits): for stretches with windows that stand earlier, which of them do."""
    place, ones = F.struct(*PLACE), lambda n: F.expr(f"shiftleft(1, {n}) - 1")
    anchors = written(_anchored(docs), "anchors")
    often = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    met = written(anchors.join(often, "h"), "met")
    groups = written(met.groupBy("h", "fp").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.max("times").alias("times")), "groups")
    hot = groups.where(F.col("times") > HOT).groupBy("h").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > HOT).select("h", F.lit(True).alias("split"))
    parts = groups.join(hot, "h", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    by_document = parts.groupBy("first.d", "first.th").agg(F.collect_list(F.struct("first.start", "n", "h", "fp", "split")).alias("parts"))
    wanted = docs.join(by_document, ["d", "th"]).dropDuplicates(["d", "th"])  # rows that are told again count once
    rows = written(_sequences(wanted), "sequences")
    whole, single = rows.where(~F.col("split")), rows.where("split")
    windows = single.groupBy("h", "sid").agg(F.min(F.struct(*PLACE, "words")).alias("f")).select("h", F.col("sid").alias("fp"), "sid", *(f"f.{c}" for c in (*PLACE, "words")), F.lit(True).alias("split"))
    streamed = whole.select("h", "fp", "sid", *PLACE, "words", "split").unionByName(windows)
    words = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, int(words // (8 * SHARD)))
    route = F.when(F.col("split"), F.xxhash64("h", "sid")).otherwise(F.xxhash64("h"))
    found = streamed.withColumn("shard", F.pmod(route, F.lit(shards))).groupBy("shard").applyInArrow(lambda t: _shard(t), "h bigint, fp bigint, sid bigint, split boolean, d bigint, th bigint, start int, mask int")
    found = written(found, "masks")
    of_windows = single.join(found.where("split").select("h", "sid", place.alias("first"), "mask"), ["h", "sid"])
    window_bit = F.when(place == F.col("first"), F.col("mask")).otherwise(F.lit(1))
    masks = found.where(~F.col("split")).select("h", "fp", "mask").unionByName(of_windows.groupBy("h", "fp", "bit").agg(F.max(window_bit).alias("m")).groupBy("h", "fp").agg(F.sum(F.expr("shiftleft(m, bit)")).cast("int").alias("mask")))
    known = groups.select("h", "fp", "first").join(masks, ["h", "fp"], "left")
    bits = F.when(place == F.col("first"), F.coalesce("mask", F.lit(0))).otherwise(ones("n"))
    return met.join(known, ["h", "fp"]).select(*PLACE, bits.alias("bits")).where("bits <> 0")


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, at: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    rows = len(at) - 1
    chosen = np.flatnonzero(keep)
    of = np.searchsorted(at, chosen, "right") - 1
    starts, ends = starts[chosen], ends[chosen]
    last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    padded, blocks, i = np.r_[data, np.uint8(32)], [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo = starts[i]
        out = padded[lo : ends[j - 1] + 1][ragged.concat_spans(starts[i:j] - lo, ends[i:j] - lo + 1)]
        gap = np.cumsum(ends[i:j] - starts[i:j] + 1) - 1
        out[gap] = 32
        blocks.append(np.delete(out, gap[last[i:j]]))
        i = j
    size = np.bincount(of, weights=ends - starts + ~last, minlength=rows).astype(np.int64) if len(of) else np.zeros(rows, np.int64)
    raw = np.concatenate(blocks) if blocks else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, n_removed, kept) of every row: spans(start, end) are the maximal runs of words that
    go, kept the other words, joined by one space."""
    docs = _documents(documents, id_col, text_col)
    gone = earlier_windows(docs).groupBy("d", "th").agg(F.collect_set(F.struct("start", "bits")).alias("gone"))
    met = docs.join(gone, ["d", "th"], "left").select("id", "text", "gone")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, data, offsets in ragged.slices(b.column(1), BLOCK):
                starts, ends, at = words_of(data, offsets)
                keep, spans = _coverage(b.column(2).slice(lo, hi - lo), at)
                gone = np.add.reduceat(np.r_[~keep, False].astype(np.int64), at[:-1]) * (np.diff(at) > 0) if hi > lo else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), spans, pa.array(gone), _kept(data, starts, ends, keep, at)], ["id", "n_words", "spans", "n_removed", "kept"])

    kind = documents.schema[id_col].dataType.simpleString()
    return met.mapInArrow(ragged.tidy(batches), f"id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def _coverage(gone: pa.Array, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(which words stay, maximal spans of those that go) from each text's (start, bits)."""
    total, rows = int(at[-1]), len(at) - 1
    change = np.zeros(total + 1, np.int64)
    sizes = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes.sum():
        parts = gone.flatten()
        start, bits = parts.field("start").to_numpy().astype(np.int64) + np.repeat(at[:-1], sizes), parts.field("bits").to_numpy()
        for k in range(STEPS):
            hit = start[(bits >> k) & 1 == 1] + k
            np.add.at(change, hit, 1)
            np.add.at(change, hit + LEAST, -1)
    out = np.cumsum(change[:-1]) > 0
    begin, end = ragged.runs(out, at)
    of = ragged.rows_of(begin, at)
    items = pa.StructArray.from_arrays([pa.array(begin - at[of], pa.int64()), pa.array(end - at[of], pa.int64())], ["start", "end"])
    borders = np.r_[0, np.cumsum(np.bincount(of, minlength=rows))].astype(np.int32) if len(of) else np.zeros(rows + 1, np.int32)
    return ~out, pa.ListArray.from_arrays(pa.array(borders), items)


def duckdb_sql() -> str:
    """The digest columns over the view documents (ids without nulls or repeats)."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - {LEAST - 2}), lambda i: {{'i': i, 'win': array_to_string(words[i:i + {LEAST - 1}], ' ')}})) AS x FROM w WHERE len(words) >= {LEAST}),
r AS (SELECT doc_id, x.i AS i FROM s QUALIFY row_number() OVER (PARTITION BY x.win ORDER BY doc_id, x.i) > 1),
g AS (SELECT DISTINCT doc_id, i + k AS pos FROM r, range({LEAST}) t(k)),
o AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (SELECT o.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM o ANTI JOIN g ON g.doc_id = o.doc_id AND g.pos = o.pos GROUP BY o.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""
