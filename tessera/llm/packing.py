"""Best-fit packing of documents into sequences by linear grouping.

1. Tokenise. A slice of texts is cut into pre-tokens by numpy passes over its bytes, and
   only distinct pre-tokens are encoded (BPE never merges across pre-tokens). A document
   longer than the capacity is cut; its first piece takes the remainder.
2. Plan, from the histogram of piece lengths alone: at most `capacity` numbers, however
   many documents there are. Large lengths are put in groups of equal cardinality and
   rounded up to their group's longest; the few resulting sizes give a configuration
   program, solved by column generation; its rounded-down solution opens sequences. What
   remains of the large ones and all small ones is placed by best fit, longest first, on
   classes of equal sequences, so that the work does not grow with the number of pieces.
   Groups are made finer, and more pieces counted as large, until no sequence can be saved; the
   first of the best plans is kept.
3. Substitute. Within each length, pieces are numbered in parallel (counts per task, then
   offsets), and the plan's intervals of numbers give each its sequence and offset.

Null text counts as empty (the end token alone); very long texts are encoded whole, then cut; ties
(pieces of one length) go by task, id and start; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import ragged
from tessera.llm.shared import text_rows, written

# The pre-token pattern of the byte-level vocabulary, and Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
SPECIAL = b"<|endoftext|>"
CACHE, POOL = 200_000, 2 << 20
SLICE = 1 << 20


class BytePairs:
    """Ids of the byte-level vocabulary for whole slices of texts."""

    def __init__(self, json_path: str, ranks_path: str | None):
        self.json_path = json_path
        self.cache, self.pool = ragged.Cache(CACHE, 2, np.int64), np.zeros(0, np.uint32)  # start and number of a pre-token's ids in the pool
        self.library = None
        self.merge = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.merge = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        kind = np.full(0x110000, OTHER, np.uint8)
        cats = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        kind[[c for c, k in enumerate(cats) if k == "L"]] = LETTER
        kind[[c for c, k in enumerate(cats) if k == "N"]] = NUMBER
        kind[WHITE_SPACE] = SPACE
        self.kind = kind

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """By the library itself, for texts that hold a special string."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
        return [np.array(self.library.encode(x, add_special_tokens=False).ids, np.uint32) for x in texts]

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of the character to which each byte belongs."""
        return ragged.byte_classes(data, self.kind)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of PATTERN begin."""
        kind = self.kinds(data)
        heads = ragged.row_starts(offsets)
        first = np.empty(len(data), bool)
        first[0] = True
        first[1:] = kind[1:] != kind[:-1]
        first[heads] = True
        # white space before a character of the same text: its last character stands alone, or
        # begins the next pre-token if it is the space U+0020
        after = first & (kind != SPACE)
        after[heads] = False
        after = np.flatnonzero(after)
        after = after[kind[after - 1] == SPACE]
        last = after - 1
        while (more := (data[last] & 0xC0) == 0x80).any():
            last = np.where(more, last - 1, last)
        first[last] = True
        first[after[data[last] == 32]] = False
        # contractions: an apostrophe that begins a pre-token
        quote = np.flatnonzero((data == 39) & first)
        if len(quote):
            ends = offsets[ragged.rows_of(quote, offsets) + 1]
            raw = data.tobytes()
            for q, end in zip(quote.tolist(), ends.tolist(), strict=True):
                tail = raw[q + 1 : min(end, q + 3)]
                n = 3 if tail in (b"re", b"ve", b"ll") else 2 if tail[:1] in (b"s", b"t", b"m", b"d") and tail else 0
                if n:
                    first[q + 1 : q + n] = False
                    if q + n < end and kind[q + n] != SPACE:
                        first[q + n] = True  # a letter run goes on behind it as a pre-token of its own
        return np.flatnonzero(first)

    def encode(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of all its texts, offsets of the ids)."""
        for lo, hi, data, offsets in ragged.slices(column, SLICE):
            if not len(data):
                yield lo, hi, np.zeros(0, np.uint32), np.zeros(hi - lo + 1, np.int64)
                continue
            raw = data.tobytes()
            if self.merge is None or SPECIAL in raw:
                texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                if self.merge is None:
                    found = self.whole(texts)
                else:
                    found = [self.whole([x])[0] if SPECIAL.decode() in x else np.array(self.merge.encode_ordinary(x), np.uint32) for x in texts]
                yield lo, hi, np.concatenate([np.zeros(0, np.uint32), *found]), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
                continue
            starts = self.starts(data, offsets)
            ends = np.r_[starts[1:], len(data)]
            codes, values, first = ragged.distinct(ragged.span_hash(data, starts, ends))

            def encoded(new: np.ndarray, raw=raw, starts=starts[first], ends=ends[first]) -> np.ndarray:
                one = self.merge._encode_single_piece
                found = [one(raw[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                size = np.fromiter(map(len, found), np.int64, len(found))
                base = len(self.pool) + np.cumsum(size) - size
                self.pool = np.concatenate([self.pool, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))])
                return np.stack([base, size], axis=1)

            base, size = self.cache.get(values, encoded).T
            n = size[codes]
            ids = self.pool[ragged.concat_spans(base[codes], base[codes] + n)]
            if len(self.pool) > POOL:
                self.cache, self.pool = ragged.Cache(CACHE, 2, np.int64), np.zeros(0, np.uint32)
            per_row = ragged.row_sums(n, ragged.rows_of(starts, offsets), hi - lo).astype(np.int64)
            yield lo, hi, ids, np.r_[0, np.cumsum(per_row)]


_ENCODERS: dict[tuple, BytePairs] = {}


def encoder(json_path: str, ranks_path: str | None) -> BytePairs:
    if (json_path, ranks_path) not in _ENCODERS:
        _ENCODERS[json_path, ranks_path] = BytePairs(json_path, ranks_path)
    return _ENCODERS[json_path, ranks_path]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(json_path, ranks_path), np.array([end_id], np.uint32).tobytes()
        for b in it:
            for lo, hi, ids, offsets in enc.encode(b.column(1)):
                row, piece, start, length, crc = [], [], [], [], []
                raw = ids.astype("<u4").tobytes()
                for r, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = raw[4 * a : 4 * z] + tail
                    n = z - a + 1
                    at, k = 0, (n - 1) % capacity + 1
                    while at < n:
                        row.append(lo + r)
                        piece.append(0 if at == 0 else piece[-1] + 1)
                        start.append(at)
                        length.append(k)
                        crc.append(zlib.crc32(own[4 * at : 4 * (at + k)]))
                        at, k = at + k, capacity
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(ragged.tidy(batches), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# The plan. A class is `n` equal sequences: their lengths in order, and what is left of each.


def _best_fit(counts: dict[int, int], capacity: int, classes: list[tuple[int, tuple[int, ...]]] = ()) -> list[tuple[int, tuple[int, ...]]]:
    """Places counts[length] pieces of each length, longest first, each into the fullest sequence
    that takes it. Equal sequences are one class, so a step treats all of them at once."""
    open_: dict[int, list] = defaultdict(list)  # what is left -> classes
    for n, have in classes:
        open_[capacity - sum(have)].append((n, have))
    left = sorted(open_)
    for size in sorted((s for s in counts if counts[s] > 0), reverse=True):
        todo = counts[size]
        while todo:
            at = bisect.bisect_left(left, size)
            if at == len(left):
                fit = capacity // size
                new = [(todo // fit, (size,) * fit)] if todo >= fit else []
                if todo % fit:
                    new.append((1, (size,) * (todo % fit)))
                todo = 0
            else:
                room = left[at]
                n, have = open_[room].pop()
                if not open_[room]:
                    del open_[room], left[at]
                fit = room // size
                used = min(n, todo // fit)
                new = [(used, have + (size,) * fit)] if used else []
                todo -= used * fit
                n -= used
                if n and todo:
                    new.append((1, have + (size,) * todo))
                    n, todo = n - 1, 0
                if n:
                    new.append((n, have))
            for k, have in new:
                room = capacity - sum(have)
                if room not in open_:
                    bisect.insort(left, room)
                open_[room].append((k, have))
    return [x for room in open_ for x in open_[room]]


def _configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """The linear program over configurations by column generation: minimise sequences so that
    demand is met. Returns (whole part, configuration) of the optimal basis."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(400):
        x = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(k))
        value, came = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        each = np.array(sizes)  # in falling order
        for room in range(1, capacity + 1):  # unbounded knapsack
            value[room] = value[room - 1]
            fits = np.searchsorted(-each, -room)  # sizes from here on fit
            if fits < k:
                gain = value[room - each[fits:]] + price[fits:]
                if gain[i := int(gain.argmax())] > value[room] + 1e-12:
                    value[room], came[room] = gain[i], fits + i
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if came[room] < 0:
                room -= 1
            else:
                column[came[room]] += 1
                room -= sizes[came[room]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
    x = np.linalg.solve(basis, demand)
    return [(int(x[j] + 1e-9), basis[:, j].round().astype(int)) for j in range(k) if x[j] >= 1 - 1e-9]


def plan(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = (6, 12, 24, 48), large: tuple[float, ...] = (1 / 3, 1 / 4, 1 / 6)) -> list[tuple[int, tuple[int, ...]]]:
    """Classes (how many sequences, the lengths each of them holds) that place every piece, by
    linear grouping with the first of these numbers of groups, and of these shares of the capacity
    above which a piece is large, that gives the fewest sequences."""
    best: list[tuple[int, tuple[int, ...]]] = []
    used, least = np.inf, -(-sum(s * n for s, n in histogram.items()) // capacity)
    for g in groups:
        before = used
        for share in large:
            classes = _grouped(histogram, capacity, g, share)
            if (n := sum(k for k, _ in classes)) < used:
                best, used = classes, n
        if used in (before, least):  # finer groups save nothing, or nothing is left to save
            break
    return best


def _grouped(histogram: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[int, tuple[int, ...]]]:
    big = [s for s in sorted(histogram, reverse=True) if capacity * large < s < capacity]
    total = sum(histogram[s] for s in big)
    if not total:  # none is large: all are placed by best fit
        return _best_fit(histogram, capacity)
    groups = min(groups, total)
    # linear grouping: equal cardinality, each group rounded up to its longest length
    group_of, sizes, demand, seen = {}, [], [], 0
    for s in big:
        g = seen * groups // total
        if not sizes or g != group_of.get("last"):
            sizes.append(s)
            demand.append(0)
            group_of["last"] = g
        group_of[s] = len(sizes) - 1
        demand[-1] += histogram[s]
        seen += histogram[s]
    classes, rest = [], dict(histogram)
    stock = [[s for s in big if group_of[s] == g] for g in range(len(sizes))]
    every = sorted(histogram)
    for n, config in sorted(_configurations(sizes, np.array(demand, float), capacity), key=lambda c: -c[0]):
        need = [g for g in range(len(sizes)) for _ in range(config[g])]
        while n:
            # actual lengths take the places of the rounded ones, the longest of each group first;
            # the last place and what then is left go to the longest lengths of all that fit
            have, used = [], {}
            for g in need[:-1]:
                s = next((s for s in stock[g] if rest[s] > used.get(s, 0)), None)
                if s is not None:
                    have.append(s)
                    used[s] = used.get(s, 0) + 1
            if len(have) < len(need) - 1:
                break
            room, at = capacity - sum(have), len(every)
            while room and (at := bisect.bisect_right(every, room, 0, at)):
                if rest[s := every[at - 1]] > used.get(s, 0):
                    have.append(s)
                    used[s] = used.get(s, 0) + 1
                    room -= s
                else:
                    at -= 1
            k = min([n, *(rest[s] // c for s, c in used.items())])
            for s, c in used.items():
                rest[s] -= c * k
            classes.append((k, tuple(sorted(have, reverse=True))))
            n -= k
    return _best_fit(rest, capacity, classes)


def intervals(classes: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, first sequence, pieces of it a sequence, offset): the
    piece numbered r of that length goes to sequence first + (r - first number) // per."""
    out, used, sequence = [], defaultdict(int), 0
    for n, have in classes:
        at = 0
        for size in sorted(set(have), reverse=True):
            per = have.count(size)
            out.append((size, used[size], used[size] + n * per, sequence, per, at))
            used[size] += n * per
            at += per * size
        sequence += n
    return out


INTERVALS = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "lo", "hi", "sequence", "per", "at")])


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    `ranks_path`, if given, holds the same vocabulary as ranks, with which distinct pre-tokens
    are encoded faster; without it the library of `json_path` encodes whole texts.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, json_path, ranks_path, capacity, end_id, id_col, text_col).withColumn("task", F.spark_partition_id()), "pieces")
    # at most tasks x capacity rows; running numbers of each length come from the tasks' counts
    counts = pieces.groupBy("task", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # <= capacity rows
    rows = intervals(plan(histogram, capacity))
    steps = spark.createDataFrame(rows, INTERVALS)
    return _placed(pieces, counts, steps, id_col)


def _placed(pieces: DataFrame, counts: DataFrame, steps: DataFrame, id_col: str) -> DataFrame:
    """Substitutes actual pieces: numbers them within (task, length), adds the earlier tasks'
    counts, and looks the number up in the plan. Long lists are spread over (task, length)."""
    before = counts.select("task", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).alias("before"))
    numbered = pieces.withColumn("k", F.row_number().over(Window.partitionBy("task", "length").orderBy("id", "start")) - 1)
    numbered = numbered.join(before, ["task", "length"]).withColumn("r", F.col("k") + F.col("before")).drop("before", "k", "task")
    plan_of = steps.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "sequence", "per", "at"))).alias("steps"))
    # plan_of has at most `capacity` rows, whatever the input
    found = numbered.join(F.broadcast(plan_of), "length").withColumn("s", F.expr("filter(steps, s -> r >= s.lo AND r < s.hi)[0]"))
    turn = F.col("r") - F.col("s.lo")
    return found.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("s.sequence") + F.floor(turn / F.col("s.per")).cast("bigint")).alias("sequence_id"),
        (F.col("s.at") + (turn % F.col("s.per")) * F.col("length")).alias("offset"),
    )
