"""Exact n-gram Jaccard self-join with set-relation skipping.

A document is the set of its distinct word n-grams (64-bit hashes). Two sets link when
100 * intersection >= percent * union. Equal sets are one class, of which one text is kept.

Order. Shingles are ordered by how often they occur: a lossy count per chunk of documents
finds every shingle above a small share of them, and the HOT most frequent are put last, by
count. Any order gives exact results; this one keeps passages that many documents share out
of the prefixes. A set's prefix is its first n - ceil(t n) + 1 shingles, so linked sets share
a prefix shingle.

Index. Prefix postings (shingle, document, size, position) are dealt by shingle as packed
arrays; those of shingles in one document only, the great majority, end there. Of lists with the
same members one stays. Pairs are first held against each other by parity bit maps, which bound
the number of elements that are not common; a map has at least twice as many bits as its set has
elements, so that it tells as much of a long text as of a short one. Texts are compared only for
pairs that pass, and no pair is looked at twice.

Skipping by answers. In each list a pivot is compared with the others. Its answers all lie in
one component, so pairs among them need no comparison: what is left are lists with several
components. Where x and y have known distances to their list's pivot, |d(x) - d(y)| > 1 - t
rules the pair out (the Jaccard distance is a metric). Rounds with other pivots follow while
the mixed lists' pairs are many for their members and rounds still settle lists.

Skipping by position. Lists that are still mixed are cut into blocks by position. Two blocks
whose sizes and positions bound the overlap below what is needed are skipped whole; the rest
are paired posting by posting, under the same bounds, and verified from the texts.

Texts without words have the empty set and no links; null counts as empty; repeated rows are
linked; rows that share an id count as one vertex, whatever their texts, and rows without an id
as none, so that they link with nothing, not even their copies, and have no component; very long texts are taken whole, one at a time if need be; an empty table gives an empty
result; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ragged
from tessera.llm.components import components
from tessera.llm.shared import if_small, settled, text_rows, written

HOT = 500_000
CHUNK = 4_000_000
OFTEN = 2
BUCKET = 400_000
BLOCK = 16
ROUNDS = 3
SPREAD, FALL = 16, 0.8
MAP_WORDS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_rng = np.random.RandomState(7919)
_MIX = _rng.randint(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    rows = len(offsets) - 1
    data = _LOWER[data]
    starts, ends = ragged.runs(_WORD[data], offsets)
    word = ragged.span_hash(data, starts, ends)
    count = np.bincount(ragged.rows_of(starts, offsets), minlength=rows) if len(starts) else np.zeros(rows, np.int64)
    at = np.r_[0, np.cumsum(count)]
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for k in range(n):
            h += word[k : len(word) - n + 1 + k] * _MIX[k]
        h = ragged.mix(h)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(h[a : b - n + 1]))
            elif b > a:
                out.append(ragged.mix(np.array([np.sum(word[a:b] * _MIX[32 : 32 + b - a]) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _prints(s: np.ndarray) -> tuple[int, int]:
    a = ragged.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(np.add.reduce(a).astype(np.int64)), int(np.bitwise_xor.reduce(ragged.mix(a)).astype(np.int64))


SETS = "id bigint, n bigint, fp1 bigint, fp2 bigint, parity array<bigint>, shingle bigint, times bigint"
SET_NAMES = ["id", "n", "fp1", "fp2", "parity", "shingle", "times"]


def parity(s: np.ndarray) -> np.ndarray:
    """A bit map of a set: bit h mod `bits` is set if an odd number of its hashes h fall on it. Two
    sets' maps differ in at most as many bits as the sets have elements that are not common. `bits`
    is a power of two, so that the halves of a map, joined by xor, are the map of half its bits."""
    bits = max(64 * MAP_WORDS, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """A row (id, n, fp1, fp2) for each text, and rows (shingle, times) of each chunk's frequent ones."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def often() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            head = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            times = np.diff(np.r_[head, len(every)])
            keep = times >= OFTEN
            s, t = every[head[keep]].view(np.int64), times[keep]
            none = pa.nulls(len(s), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(s), pa.list_(pa.int64())), pa.array(s), pa.array(t)], SET_NAMES)

        for b in it:
            for lo, hi, data, offsets in ragged.slices(b.column(1)):
                sets = shingle_sets(data, offsets, n)
                prints = [_prints(s) if len(s) else (0, 0) for s in sets]
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([parity(s) for s in sets], pa.list_(pa.int64())), none, none], SET_NAMES)
                for s, p in zip(sets, prints, strict=True):
                    if len(s) and p not in seen:
                        seen.add(p)
                        held.append(s)
                        size += len(s)
                if size >= CHUNK:
                    yield often()
                    held, size, seen = [], 0, set()
        if held:
            yield often()

    return rows.mapInArrow(ragged.tidy(batches), SETS)


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered_prefix(s: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set in the global order: by hash, the hot ones last by rank."""
    k = _prefix_length(len(s), percent)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[at] == s
        cold = s[~is_hot]
        if len(cold) < k:
            own = s[is_hot]
            return np.r_[cold, own[np.argsort(rank[at[is_hot]], kind="stable")]][:k]
        return cold[:k]
    return s[:k]


PACKED = "bucket bigint, shingles binary, ids binary, sizes binary, places binary, listed binary"


def _packed(texts: DataFrame, n: int, percent: int, hot: np.ndarray, rank: np.ndarray, buckets: int) -> DataFrame:
    """The prefix postings of slices of texts, by bucket.

    Of a shingle that several texts of a slice hold, all postings go to a bucket of the slice's
    own, which only unpacks them, and one goes to the shingle's bucket: there no list has more
    entries than there are slices. A task that is run again must give the same slices and buckets,
    as some readers may have the first run's: texts are sorted in each task, whatever order a
    shuffle delivered them in, and a slice's bucket is a hash of its first id.
    """
    shared = texts.sparkSession.sparkContext.broadcast((hot, rank))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        for b in it:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, _data, _offsets in ragged.slices(b.column(1), 4 << 20):
                sets = _of(b.column(1).slice(lo, hi - lo), n)
                own = [(k, ordered_prefix(s, hot, rank, percent)) for k, s in enumerate(sets) if len(s)]
                if not own:
                    continue
                size = np.array([len(p) for _, p in own])
                h = np.concatenate([p for _, p in own])
                row = np.repeat(np.array([k for k, _ in own]), size)
                place = np.concatenate([np.arange(len(p)) for _, p in own]).astype(np.int32)
                doc, total = ids[lo + row], np.array([len(s) for s in sets], np.int32)[row]
                order = np.argsort(h, kind="stable")
                h, doc, total, place = h[order], doc[order], total[order], place[order]
                first = np.r_[True, h[1:] != h[:-1]]
                head = np.flatnonzero(first)
                many = np.repeat(np.diff(np.r_[head, len(h)]) > 1, np.diff(np.r_[head, len(h)]))
                mine = int(ragged.mix(ids[lo : lo + 1].view(np.uint64))[0] % np.uint64(buckets))
                out = [(-1 - mine, np.flatnonzero(many))] if many.any() else []
                bucket = (ragged.mix(h[head]) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]])
                out += [(int(bucket[by[a]]), head[by[a:z]]) for a, z in zip(cut, np.r_[cut[1:], len(by)], strict=True)]
                cols = [(h, np.uint64), (doc, np.int64), (total, np.int32), (place, np.int32), (many, np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), *(pa.array([c[i].astype(t).tobytes() for _, i in out], pa.binary()) for c, t in cols)], ["bucket", "shingles", "ids", "sizes", "places", "listed"])

    return texts.sortWithinPartitions("id", "text").mapInArrow(ragged.tidy(pack), PACKED)


def _postings(texts: DataFrame, n: int, percent: int, hot: np.ndarray, rank: np.ndarray, buckets: int) -> DataFrame:
    """(shingle, id, n, pos) of the prefix postings of shingles that at least two texts hold."""

    def unpack(key: tuple, t: pa.Table) -> pa.Table:
        h, doc, total, place, listed = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("shingles", np.uint64), ("ids", np.int64), ("sizes", np.int32), ("places", np.int32), ("listed", np.uint8)))
        if key[0].as_py() >= 0:
            order = np.argsort(h, kind="stable")
            h, doc, total, place, listed = h[order], doc[order], total[order], place[order], listed[order]
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            keep = (same[1:] | same[:-1]) & (listed == 0)
            h, doc, total, place = h[keep], doc[keep], total[keep], place[keep]
        return pa.table([pa.array(h.view(np.int64)), pa.array(doc), pa.array(total), pa.array(place)], ["shingle", "id", "n", "pos"])

    return _packed(texts, n, percent, hot, rank, buckets).groupBy("bucket").applyInArrow(unpack, "shingle bigint, id bigint, n int, pos int")


def _ends(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of a table (id, ...) whose id is an end of a pair."""
    needed = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    return table.join(if_small(needed), "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, common, n_a, n_b) of each pair, from the texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            texts_a, texts_b = b.column(2), b.column(3)
            step = 512
            for at in range(0, b.num_rows, step):
                left = _of(texts_a.slice(at, step), n)
                right = _of(texts_b.slice(at, step), n)
                out += [(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(left, right, strict=True)]
            c = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *c], ["a", "b", "common", "n_a", "n_b"])

    kept = written(_ends(texts, pairs), "texts")
    b_side = kept.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    a_side = kept.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    full = pairs.select("a", "b").join(b_side, "b").join(a_side, "a").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(ragged.tidy(batches), "a bigint, b bigint, common bigint, n_a bigint, n_b bigint")


def _of(column, n: int) -> list[np.ndarray]:
    return [s for _, _, data, offsets in ragged.slices(column) for s in shingle_sets(data, offsets, n)]


def _can_link(percent: int, n_a: str, n_b: str, overlap: str | None = None) -> str:
    """SQL: sizes (and an upper bound of the overlap) allow a link."""
    o = overlap or f"least({n_a}, {n_b})"
    return f"100 * ({o}) >= {percent} * ({n_a} + {n_b} - ({o}))"


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = text_rows(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    found = written(_sets(rows, n), "sets")
    sets = found.where("n IS NOT NULL").select("id", "n", "fp1", "fp2")
    hot, rank = _hot(found.where("shingle IS NOT NULL"))
    classes = found.where("n > 0 AND id IS NOT NULL").groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep"), F.first("parity").alias("parity"))
    classes = written(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total * (100 - percent) // 100 // BUCKET))
    texts = _representatives(rows.where("id IS NOT NULL"), sets, classes)
    lists = settled(rows.sparkSession, "lists", lambda: _one_of_equal(_postings(texts, n, percent, hot, rank, buckets)))
    comp = _linked(lists, rows, classes, n, percent)
    out = _members(sets, classes, comp)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def _hot(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their ranks: all whose count is in a class of counts
    (eight to a doubling) such that no more than HOT are in it and above."""
    often = written(counted.groupBy("shingle").agg(F.sum("times").alias("times")).withColumn("class", F.floor(8 * F.log2("times")).cast("int")), "often")
    left, least = HOT, None
    for r in sorted(often.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # a few hundred rows
        left -= r["count"]
        if left < 0:
            break
        least = r["class"]
    top = often.where(F.col("class") >= least).select("shingle", "times").toArrow() if least is not None else None  # at most HOT rows
    if top is None or not top.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    shingle, times = top["shingle"].to_numpy().view(np.uint64), top["times"].to_numpy()
    by, rank = np.argsort(shingle), np.empty(len(shingle), np.int32)
    rank[np.lexsort((shingle, times))] = np.arange(len(shingle))
    return shingle[by], rank[by]


def _linked(lists: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(id, component) of the sets that have links, None if no list can give one."""
    spark = lists.sparkSession
    known = comp = links = None  # (a, b, lo, hi): pairs looked at and what is known of their distance
    before = 0
    for turn in range(ROUNDS + 1):
        now = lists.withColumn("component", F.col("id")) if comp is None else lists.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # lists of one component have no more pairs to give
        size = now.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi")
        size = written(size.select("shingle", "members"), "mixed")
        members, pairs_at_most = size.agg(F.sum("members"), F.sum(F.col("members").cast("double") ** 2)).first()
        if not members:
            break
        now = written(now.join(if_small(size.select("shingle")), "shingle", "left_semi"), "mixed-lists") if comp is not None else now
        # at every size the first turn is a pivot's: later ones derive from its answers
        last = turn == ROUNDS or turn > 0 and pairs_at_most <= SPREAD * members or turn > 1 and members > FALL * before
        before = members
        seen, cross = known, last

        def candidates(now=now, seen=seen, cross=cross, turn=turn) -> DataFrame:
            pairs = _cross(now, seen, classes, percent) if cross else _star(now, turn, percent)
            return pairs if seen is None else pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")

        pairs = settled(spark, "pairs", candidates)
        bounded = settled(spark, "bounded", lambda pairs=pairs: _bounded(pairs, classes, percent))
        new = settled(spark, "tested", lambda bounded=bounded: _verified(bounded.where("may_link"), rows, n))
        d = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
        told = new.select("a", "b", d.alias("lo"), d.alias("hi")).unionByName(bounded.where("NOT may_link").select("a", "b", F.col("least_d").alias("lo"), F.lit(1.0).alias("hi")))
        known = told if known is None else known.unionByName(told)
        own = new.where(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b")
        links = own if links is None else links.unionByName(own)
        comp = settled(spark, "components", lambda links=links: components(links))
        if last:
            break
    return comp


def _representatives(rows: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """One text of each class: without the ids that represent none."""
    other = sets.where("n > 0").select("id").distinct().join(classes.select(F.col("rep").alias("id")), "id", "left_anti")
    return rows.join(if_small(written(other, "copies")), "id", "left_anti")


def _one_of_equal(lists: DataFrame) -> DataFrame:
    """Lists with the same members give the same pairs: one of them stays. Members are told apart
    by count and two 64-bit sums of their hashes."""
    lists = written(lists, "postings")
    of = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = written(of.groupBy("members", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle"), "chosen")
    return lists.join(if_small(one), "shingle", "left_semi")


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, may_link, least_d): whether the sizes and the parity maps, which bound the number of
    elements that are not common, still allow a link, and how far apart the sets are at least."""
    of = written(_ends(classes.select(F.col("rep").alias("id"), "n", "parity"), pairs), "maps")
    a = of.select(F.col("id").alias("a"), F.col("n").alias("m_a"), F.col("parity").alias("p_a"))
    b = of.select(F.col("id").alias("b"), F.col("n").alias("m_b"), F.col("parity").alias("p_b"))
    met = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("alike", F.expr(_can_link(percent, "m_a", "m_b")))
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y)"
    for _ in range(((100 - 1) // percent).bit_length()):  # sets of sizes that allow a link have maps of so many doublings at most
        met = met.withColumns({p: F.when(F.expr(f"size({p}) > size({q})"), F.expr(half.format(p))).otherwise(F.col(p)) for p, q in (("p_a", "p_b"), ("p_b", "p_a"))})
    differ = F.expr("aggregate(zip_with(p_a, p_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    met = met.withColumn("differ", F.when(F.col("alike"), differ).otherwise(F.lit(0)))
    may = F.expr(f"alike AND (100 + {percent}) * differ <= (100 - {percent}) * (m_a + m_b)")
    least = F.expr("greatest(2 * differ / (m_a + m_b + differ), 1 - least(m_a, m_b) / greatest(m_a, m_b))")
    return met.groupBy("a", "b").agg(F.max(may).alias("may_link"), F.min(least).alias("least_d"))


def _members(sets: DataFrame, classes: DataFrame, linked: DataFrame | None) -> DataFrame:
    """(id, n, rep, component) of every row: classes get their components, rows their classes."""
    of = classes.select("n", "fp1", "fp2", "rep")
    of = of.withColumn("component", F.lit(None).cast("bigint")) if linked is None else of.join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    return sets.join(written(of, "class-components"), ["n", "fp1", "fp2"], "left")


def _star(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a < b) of each list's pivot with its members of other components. Pivots are chosen
    by a few orders of the ids, so that a document meets few different ones."""
    order = F.xxhash64("id", (F.col("shingle") % 2), F.lit(turn)) if turn else F.col("id")
    pivot = written(lists.groupBy("shingle").agg(F.min_by(F.struct("id", "n", "pos", "component"), F.struct(order, "id")).alias("p")).select("shingle", F.col("p.id").alias("p_id"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"), F.col("p.component").alias("p_component")), "pivots")
    bound = "least(pos, p_pos) + 1 + least(n - pos - 1, p_n - p_pos - 1)"
    met = lists.join(if_small(pivot), "shingle").where("id <> p_id AND component <> p_component").where(_can_link(percent, "n", "p_n", bound))
    return met.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()


def _cross(lists: DataFrame, known: DataFrame | None, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components in each list, blocks of positions first. Postings carry
    their sets' maps folded to MAP_WORDS words, so that the join itself drops most pairs that cannot
    link; the full maps are held against each other once for each pair that is left."""
    pivot = lists.groupBy("shingle").agg(F.min("id").alias("p_id"))
    if known is None:
        known = lists.limit(0).selectExpr("id AS a", "id AS b", "0D AS lo", "0D AS hi")
    known = written(known.groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "known")
    near = known.select(F.col("a").alias("p_id"), F.col("b").alias("id"), "lo", "hi").unionByName(known.select(F.col("b").alias("p_id"), F.col("a").alias("id"), "lo", "hi"))
    own = lists.join(if_small(written(pivot, "pivots")), "shingle").join(if_small(near), ["p_id", "id"], "left").withColumn("blk", F.floor(F.col("pos") / BLOCK))
    words = [f"p{k}" for k in range(MAP_WORDS)]
    maps = classes.groupBy(F.col("rep").alias("id")).agg(F.first("parity").alias("parity"), F.count(F.lit(1)).alias("texts"))
    folded = (F.expr(f"aggregate(filter(parity, (x, i) -> i % {MAP_WORDS} = {k}), 0L, (s, x) -> s ^ x)").alias(w) for k, w in enumerate(words))
    own = own.join(maps.select("id", "texts", *folded), "id")
    own = written(own.select(*words, "texts", "shingle", "id", "n", "pos", "component", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.when(F.col("id") == F.col("p_id"), 0.0).otherwise(F.coalesce("hi", F.lit(1.0))).alias("hi"), "blk"), "blocks")
    blocks = written(own.groupBy("shingle", "blk").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("component").alias("c_lo"), F.max("component").alias("c_hi")), "block-index")
    x, y = blocks.alias("x"), blocks.alias("y")
    # the overlap is at most the last place of the lower block + 1 + what can follow of the smaller set
    reach = f"least(x.blk, y.blk) * {BLOCK} + {BLOCK} + least(x.n_hi - x.blk * {BLOCK}, y.n_hi - y.blk * {BLOCK})"
    smaller = "greatest(x.n_lo, y.n_lo)"
    met = x.join(y, F.expr("x.shingle = y.shingle AND x.blk <= y.blk")).where("NOT (x.c_lo = y.c_hi AND x.c_hi = y.c_lo)").where(f"100 * least({reach}, x.n_hi, y.n_hi) >= {percent} * {smaller}")
    met = met.select(F.col("x.shingle").alias("shingle"), F.col("x.blk").alias("x_blk"), F.col("y.blk").alias("y_blk"))
    carried = ("id", "n", "pos", "component", "lo", "hi", "texts", *words)
    left = own.select("shingle", F.col("blk").alias("x_blk"), *(F.col(c).alias(f"x_{c}") for c in carried))
    right = own.select("shingle", F.col("blk").alias("y_blk"), *(F.col(c).alias(f"y_{c}") for c in carried))
    pairs = left.join(met, ["shingle", "x_blk"]).join(right, ["shingle", "y_blk"])
    bound = "least(x_pos, y_pos) + 1 + least(x_n - x_pos - 1, y_n - y_pos - 1)"
    pairs = pairs.where("x_component <> y_component").where("x_blk < y_blk OR x_id < y_id").where(_can_link(percent, "x_n", "y_n", bound))
    pairs = pairs.where(f"greatest(x_lo - y_hi, y_lo - x_hi) <= {100 - percent} / 100D + 1e-9")
    differ = " + ".join(f"bit_count(x_{w} ^ y_{w})" for w in words)
    # an id with several texts has one map here, which says nothing of the others
    pairs = pairs.where(f"x_texts + y_texts > 2 OR (100 + {percent}) * ({differ}) <= (100 - {percent}) * (x_n + y_n)")
    return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
