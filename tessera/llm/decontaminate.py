"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Distance is the word edit distance between a benchmark item and the stretch of a document that
fits it best. Words are maximal runs of ASCII letters, digits and non-ASCII characters, ASCII
letters lower-cased. A document holds an item when the distance is at most max_edit times the
item's words.

1. An item of more than PIECE words is cut into even pieces; of an item within the allowed
   distance at least one piece is within its share of it. Pieces are put in classes by their
   number of words. A window of a class starts at any word. Windows that cannot fit are left out
   first, without loss: k edits spoil at most 2k word pairs, so most pairs of a window's first
   words must be pairs of the benchmark. Those are held as a bit map of fixed size, whatever the
   benchmark's.
2. A CGK random walk reads each remaining window and each piece; it maps a small edit distance
   to a small Hamming distance of the walks' outputs. `walks` walks with `samples` samples of
   `bits` places each give signatures. Windows none of whose signatures is in a second bit map
   of fixed size go; equal signatures, found by a Spark join, make candidates. Without edits
   the signatures are equal for certain; the tests ask for 0.95 of the passages with 20 % of their
   words edited, in items of 12 to 200 words.
3. Items so short that no word of them may be edited (fewer than 1 / max_edit words) need no
   walk: their words as they stand are the signature, so all are found.
4. Candidates are verified exactly by a bit-parallel search of the whole item in the stretch of
   the document that can hold it.

Items of fewer than min_words words (by default, without any) are not searched for. Null and empty
texts hold nothing; very long texts and items are taken whole; of stretches that fit an item
equally well the first counts; repeated rows give one result; an empty table of either kind gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ragged
from tessera.llm.shared import text_rows, written

BITS = 24
PIECE = 30
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_GRAM = np.uint64(0xA24BAED4963EE407)
_SEED = np.random.RandomState(104729).randint(0, 2**63, 4096, dtype=np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and where each text's words begin and end among them."""
    data = _LOWER[data]
    starts, ends = ragged.runs(_WORD[data], offsets)
    h = ragged.span_hash(data, starts, ends)
    count = np.bincount(ragged.rows_of(starts, offsets), minlength=len(offsets) - 1) if len(starts) else np.zeros(len(offsets) - 1, np.int64)
    return h, np.r_[0, np.cumsum(count)].astype(np.int64)


def pair_bits(h: np.ndarray) -> np.ndarray:
    """The place in the bit map of each word and its successor."""
    return (ragged.mix(h[:-1] * _PAIR + h[1:]) >> np.uint64(64 - BITS)).astype(np.int64)


def size_class(n: int, least: int) -> tuple[int, int]:
    """(fewest, most) words of the class in which an item of n words falls."""
    low = least
    while (high := max(low + 1, low * 5 // 4)) <= n:
        low = high
    return low, high - 1


def signatures(h: np.ndarray, at: np.ndarray, end: np.ndarray, width: int, walks: int, samples: int, bits: int) -> np.ndarray:
    """One row for each window h[at:at + width] (cut at end): walks * samples signatures."""
    steps = 2 * width
    n = np.minimum(end - at, width)
    out = np.empty((len(at), walks * samples), np.uint64)
    for w in range(walks):
        place = np.zeros(len(at), np.int64)
        read = np.empty((len(at), steps), np.uint64)
        for j in range(steps):
            c = np.where(place < n, h[np.minimum(at + place, len(h) - 1)], np.uint64(0))
            read[:, j] = c
            place += (ragged.mix(c ^ _SEED[w * 512 + j % 512]) >> np.uint64(63)).astype(np.int64)
        rng = np.random.RandomState(w * 7919 + width)
        for s in range(samples):
            pick = np.sort(rng.choice(steps, min(bits, steps), replace=False))
            sig = np.full(len(at), np.uint64(width * 65_536 + w * samples + s))
            for j in pick:
                sig = ragged.mix(sig * np.uint64(0x9E3779B97F4A7C15) + read[:, j])
            out[:, w * samples + s] = sig
    return out


def best_fit(item: list[int], text: list[int]) -> tuple[int, int]:
    """(edit distance, end) of the stretch of text nearest to item; the first such end."""
    m = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for k, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def pieces_of(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the even pieces of an item of n words."""
    parts = -(-n // PIECE)
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    g = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        g = ragged.mix(g * _GRAM + h[k : len(h) - n + 1 + k])
    return g


def bit_map(bits: DataFrame) -> np.ndarray:
    """A map of 2 ** BITS flags, packed, with those set that column bit names: put together in
    words of 64 by the tasks, so that at most 2 ** (BITS - 6) rows reach the driver."""
    words = bits.groupBy((F.col("bit").bitwiseAND(F.lit((1 << BITS) - 1)) / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("flags")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["flags"].to_numpy()
    return out.view(np.uint8)


def is_set(flags: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether these flags of a packed map are set."""
    return (flags[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, min_words: int = 1, walks: int = 6, samples: int = 8, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word, similarity) of every item that a document holds."""
    spark, low_bits = docs.sparkSession, np.int64((1 << BITS) - 1)

    def read_items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, at = words_of(*ragged.buffers(b.column(1)))
            rows = [k for k in range(b.num_rows) if at[k + 1] - at[k] >= max(1, min_words)]
            sigs, pairs, windows = [], [], []
            for k in rows:
                own = h[at[k] : at[k + 1]]
                m = len(own)
                edits = int(max_edit * m)
                if not edits:
                    sigs.append(grams(own, m).view(np.int64).tolist())
                    windows.append([(-m, 0, m)])
                    pairs.append([])
                    continue
                found, windows_of = [], []
                for first, n in pieces_of(m):
                    low, _ = size_class(n, 2)
                    found.append(signatures(own, np.array([first]), np.array([first + n]), low, walks, samples, bits)[0].view(np.int64))
                    windows_of.append((low, first + edits, m - first + edits))
                sigs.append(np.unique(np.concatenate(found)).tolist())
                windows.append(windows_of)
                pairs.append(np.unique(pair_bits(own)).tolist())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows, pa.int64())), pa.array([h[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary()),
                pa.array([[dict(zip(("low", "back", "ahead"), w, strict=True)) for w in x] for x in windows], pa.list_(pa.struct([("low", pa.int64()), ("back", pa.int64()), ("ahead", pa.int64())]))),
                pa.array(sigs, pa.list_(pa.int64())), pa.array(pairs, pa.list_(pa.int64())),
            ], ["item", "words", "windows", "sigs", "pairs"])

    source = text_rows(benchmark, item_col, item_text_col)
    kind = source.schema["id"].dataType.simpleString()
    items = written(source.mapInArrow(ragged.tidy(read_items), f"item {kind}, words binary, windows array<struct<low: bigint, back: bigint, ahead: bigint>>, sigs array<bigint>, pairs array<bigint>"), "items")
    # classes by window length (of short items, minus that): how far before and behind a window its item may reach
    classes = [tuple(r) for r in items.select(F.inline("windows")).groupBy("low").agg(F.max("back"), F.max("ahead")).collect()]
    shared = spark.sparkContext.broadcast((bit_map(items.select(F.explode("pairs").alias("bit"))), bit_map(items.select(F.explode("sigs").alias("bit")))))

    def found_in(h: np.ndarray, at: np.ndarray, pairs: np.ndarray, wanted: np.ndarray) -> Iterator[tuple]:
        """(first words of windows, their signatures, back, ahead) for each class."""
        end = np.repeat(at[1:], np.diff(at))
        hit = np.r_[is_set(pairs, pair_bits(h)) & (end[:-1] == end[1:]), False]
        sums = np.r_[0, np.cumsum(hit, dtype=np.int64)]
        every = np.arange(len(h))
        for low, back, ahead in classes:
            if low < 0:
                g = grams(h, -low).view(np.int64)
                p = np.flatnonzero(is_set(wanted, g & low_bits) & (every[: len(g)] - low <= end[: len(g)]))
                yield p, g[p][:, None], back, ahead
                continue
            k = int(max_edit * (size_class(low, 2)[1]))
            last = np.minimum(every + low, end)
            p = every[(sums[np.maximum(last - 1, every)] - sums[every] >= last - every - 1 - 2 * k) & (last - every >= low - k)]
            for some in np.array_split(p, max(1, len(p) // 20_000)):
                if len(some):
                    yield some, signatures(h, some, end[some], low, walks, samples, bits).view(np.int64), back, ahead

    def read_docs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, wanted = shared.value
        for b in it:
            for lo, _hi, data, offsets in ragged.slices(b.column(1)):
                h, at = words_of(data, offsets)
                if not len(h) or not classes:
                    continue
                spans = []
                for p, sig, back, ahead in found_in(h, at, pairs, wanted):
                    good = is_set(wanted, sig & low_bits)
                    rows = np.flatnonzero(good.any(axis=1))
                    spans += [(p[r], sig[r][good[r]], back, ahead) for r in rows.tolist()]
                if not spans:
                    continue
                p = np.array([x[0] for x in spans])
                row = np.searchsorted(at, p, "right") - 1
                a = np.maximum(p - np.array([x[2] for x in spans]), at[row])
                z = np.minimum(p + np.array([x[3] for x in spans]), at[row + 1])
                order = np.argsort(a, kind="stable")
                row, a, z = row[order], a[order], z[order]
                reach = np.maximum.accumulate(z)
                cut = np.flatnonzero(np.r_[True, a[1:] >= reach[:-1]])
                border = np.r_[cut, len(a)]
                sigs = [np.unique(np.concatenate([spans[order[k]][1] for k in range(x, y)])).tolist() for x, y in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
                start, stop = a[cut], reach[border[1:] - 1]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(lo + row[cut], pa.int64())), pa.array(start - at[row[cut]], pa.int64()),
                    pa.array([h[x:y].tobytes() for x, y in zip(start, stop, strict=True)], pa.binary()), pa.array(sigs, pa.list_(pa.int64())),
                ], ["id", "start", "words", "sigs"])

    texts = text_rows(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    stretches = written(texts.mapInArrow(ragged.tidy(read_docs), f"id {kind}, start bigint, words binary, sigs array<bigint>").withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    met = stretches.select("stretch", F.explode("sigs").alias("sig")).join(items.select("item", F.explode("sigs").alias("sig")), "sig").select("stretch", "item").distinct()

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [np.frombuffer(x, np.int64).tolist() for x in b.column(3).to_pylist()]
            wanted = [np.frombuffer(x, np.int64).tolist() for x in b.column(4).to_pylist()]
            found = [best_fit(i, t) for i, t in zip(wanted, texts, strict=True)]
            keep = [k for k, (d, _) in enumerate(found) if d <= int(max_edit * len(wanted[k]))]
            rows = b.take(pa.array(keep, pa.int64()))
            starts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([found[k][0] for k in keep], pa.int64()), pa.array([len(wanted[k]) for k in keep], pa.int64()), pa.array([starts[k] + found[k][1] for k in keep], pa.int64())], ["id", "item", "distance", "item_words", "end_word"])

    full = met.join(stretches.select("stretch", "id", "start", "words"), "stretch").join(items.select("item", F.col("words").alias("item_of")), "item")
    item_kind = items.schema["item"].dataType.simpleString()
    found = full.select("id", "item", "start", "words", "item_of").mapInArrow(ragged.tidy(verify), f"id {kind}, item {item_kind}, distance bigint, item_words bigint, end_word bigint")
    best = found.groupBy("id", "item").agg(F.min(F.struct("distance", "end_word", "item_words")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col if item_col != id_col else "item"), "m.distance", "m.item_words", "m.end_word", F.round(1 - F.col("m.distance") / F.col("m.item_words"), 6).alias("similarity"))
