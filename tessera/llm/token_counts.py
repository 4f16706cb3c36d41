"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch lie in one ragged numpy array of symbol ids. In every round each
pre-token's best pair (highest score, leftmost on ties) is merged, all pre-tokens at once;
those without a mergeable pair leave. What survives is counted. Equal pre-tokens of a slice
are merged once, and a bounded cache keeps counts of those seen before. A pre-token of more
than LONG characters (text without spaces) is an array of its own, in which all places of the
lowest rank are merged at once.

The rules are those of a sentencepiece BPE model without a normaliser that changes
characters: a space is put before a text, spaces become U+2581, pairs are merged by the
score of the joined piece, and a character outside the vocabulary costs its UTF-8 bytes.
No piece holds U+2581 after another character, so a pre-token (spaces, then characters up
to the next space) is merged on its own. A model for which either does not hold is refused when
it is loaded.

Null and empty texts have 0 tokens; very long texts are counted whole; of equal scores the
leftmost pair merges first; repeated rows are counted each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ragged
from tessera.llm.shared import text_rows

SPACE = "▁"
CACHE = 400_000
SLICE = 2 << 20
LONG = 512
NONE = np.iinfo(np.int32).max
# Texts that a normaliser or another treatment of spaces would change.
PROBES = ("a  b ", " a", "\ta\nb", "ﬁ Ａ１ ½", "e\u0301 é", "\u200b\u3000x", "ＡＢＣ ｶﾞ", "A b C", "<s> </s>", "\x00\ufeff")


class PieceMerger:
    """The merge table of a sentencepiece BPE model and its batched use."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError(f"{model_path}: pieces reach over spaces")
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        rank, last, r = {}, None, -1
        for i in order:  # equal scores share a rank, so that the leftmost pair wins
            s = sp.get_score(i)
            if s != last:
                r, last = r + 1, s
            rank[i] = r
        # characters that only occur inside pieces get ids after the vocabulary
        self.first = np.full(0x110000, -1, np.int32)
        extra = size
        for piece, i in ids.items():
            if len(piece) == 1:
                self.first[ord(piece)] = i
        single = dict(ids)
        for piece in ids:
            for c in piece:
                if c not in single:
                    single[c] = extra
                    self.first[ord(c)] = extra
                    extra += 1
        pairs = [(single[p[:k]], single[p[k:]], rank[i], i) for p, i in ids.items() if len(p) > 1 for k in range(1, len(p)) if p[:k] in single and p[k:] in single]
        left, right, ranks, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.width = np.uint64(extra)
        self.index = ragged.HashIndex(left.astype(np.uint64) * self.width + right.astype(np.uint64))
        self.rank, self.made = ranks.astype(np.int32), made.astype(np.int32)
        self.size = size

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        known = (left >= 0) & (right >= 0)
        at = self.index.find(np.where(known, left, 0).astype(np.uint64) * self.width + np.where(known, right, 0).astype(np.uint64))
        return np.where(known, at, -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, given with U+2581 for spaces."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        ids = self.first[code].copy()
        lost = ids < 0
        if lost.any():  # byte fallback: a character outside the vocabulary costs its bytes
            c = code[lost]
            out += np.bincount(word[lost], weights=np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4))), minlength=len(words)).astype(np.int64)
        long = size > LONG
        if long.any():  # one after another: each of them is an array large enough
            begin = np.cumsum(size) - size
            for k in np.flatnonzero(long).tolist():
                left = self._merged(ids[begin[k] : begin[k] + size[k]])
                out[k] += self._weights(left).sum()
            rest = ~long[word]
            ids, word = ids[rest], word[rest]
            if not len(ids):
                return out
        at = np.full(len(ids), -1, np.int32)  # of the pair that each symbol forms with the next
        if len(ids) > 1:
            same = word[1:] == word[:-1]
            at[:-1][same] = self._pairs(ids[:-1][same], ids[1:][same])
        while True:
            rank = np.where(at >= 0, self.rank[at], NONE)
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, head)
            span = np.diff(np.r_[head, len(word)])
            live = np.repeat(best < NONE, span)
            if not live.all():  # these pre-tokens are done: count what is left of them
                done = ~live & (ids >= 0)
                out += np.bincount(word[done], weights=self._weights(ids[done]), minlength=len(words)).astype(np.int64)
                ids, word, at, rank = ids[live], word[live], at[live], rank[live]
                span, best = span[best < NONE], best[best < NONE]
                if not len(ids):
                    return out
            hit = np.flatnonzero(rank == np.repeat(best, span))
            hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]
            ids[hit] = self.made[at[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            new = hit - np.arange(len(hit))  # one symbol goes from each pre-token before it
            ids, word, at = ids[keep], word[keep], at[keep]
            for p in (new, new - 1):
                ok = (p >= 0) & (p + 1 < len(ids))
                q = p[ok]
                q_same = word[q] == word[q + 1]
                at[q[~q_same]] = -1
                q = q[q_same]
                at[q] = self._pairs(ids[q], ids[q + 1])
            at[-1] = -1

    def _weights(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of each symbol that no pair took: a character that is no piece costs its bytes."""
        return np.where(ids < self.size, 1, [len(chr(c).encode()) for c in self._chars(ids)] if (ids >= self.size).any() else 1)

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        """The symbols that are left of one long pre-token, without those that are not in the vocabulary.

        Symbols are linked to their neighbours, places wait under the rank of the pair that begins there, and
        the lowest rank's places are merged at once, from the left and without overlaps, as one by one would.
        That is so unless a merge makes a pair of a rank as low, which would come before the next; then only
        the first is done. Work is in proportion to merges, not to rounds times length."""
        n = len(ids)
        ids, alive = np.append(ids, -1), np.ones(n + 1, bool)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], alive[n] = n, False
        at = np.full(n + 1, -1, np.int32)
        at[: n - 1] = self._pairs(ids[: n - 1], ids[1:n])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[at[places] >= 0]
            if not len(places):
                return
            r = self.rank[at[places]]
            order = np.argsort(r, kind="stable")
            r, places = r[order], places[order]
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]).tolist()
            for a, b in zip(cut, [*cut[1:], len(r)], strict=True):
                one = int(r[a])
                if one not in waiting:
                    waiting[one] = []
                    heapq.heappush(ranks, one)
                waiting[one].append(places[a:b])

        def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            pair = self._pairs(left, right)
            return np.where(pair >= 0, self.rank[pair], NONE)

        wait(np.arange(n))
        while ranks:
            lowest = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(lowest)))
            places = places[alive[places] & (at[places] >= 0)]
            places = places[self.rank[at[places]] == lowest]
            if not len(places):
                continue
            # of a run of places each of which begins where the last one ends, every second is taken
            tied = np.r_[False, after[places[:-1]] == places[1:]]
            head = np.flatnonzero(~tied)
            taken = places[(np.arange(len(places)) - np.repeat(head, np.diff(np.r_[head, len(places)]))) % 2 == 0]
            made, right = self.made[at[taken]], after[taken]
            if len(taken) > 1:
                last, next_ = before[taken], after[right]
                beside = np.r_[False, taken[1:] == after[right[:-1]]]  # the last merge ends where this one begins
                least = np.minimum(rank_of(np.where(last >= 0, ids[last], -1), made), rank_of(made, ids[next_]))
                least[beside] = np.minimum(least[beside], rank_of(made[np.flatnonzero(beside) - 1], made[beside]))
                if least.min() <= lowest:
                    waiting[lowest] = [taken[1:]]
                    heapq.heappush(ranks, lowest)
                    taken, made, right = taken[:1], made[:1], right[:1]
            ids[taken] = made
            alive[right] = False
            beyond = after[right]
            after[taken], before[beyond] = beyond, taken
            changed = np.unique(np.concatenate([taken, before[taken]]))
            changed = changed[changed >= 0]
            at[changed] = np.where(after[changed] < n, self._pairs(ids[changed], ids[after[changed]]), -1)
            wait(changed)
        left = ids[:n][alive[:n]]
        return left[left >= 0]

    def _chars(self, ids: np.ndarray) -> list[int]:
        where = {int(self.first[c]): int(c) for c in np.flatnonzero(self.first >= self.size)}
        return [where.get(int(i), 97) for i in ids]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before every text that is not empty; U+2581 becomes a space."""
    raw = data.tobytes()
    if b"\xe2\x96\x81" in raw:
        parts = [raw[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    heads = ragged.row_starts(offsets)
    return np.insert(data, heads, 32), offsets + np.r_[0, np.cumsum(offsets[1:] > offsets[:-1])]


_MERGERS: dict[str, tuple[PieceMerger, ragged.Cache]] = {}


def _merger(path: str) -> tuple[PieceMerger, ragged.Cache]:
    if path not in _MERGERS:
        import sentencepiece

        _MERGERS[path] = PieceMerger(path), ragged.Cache(CACHE, 1, np.int64)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if count_column(pa.array(PROBES), path).tolist() != [len(sp.encode(x)) for x in PROBES]:
            del _MERGERS[path]
            raise ValueError(f"{path}: not a byte-pair model without a normaliser")
    return _MERGERS[path]


def count_column(column, model_path: str) -> np.ndarray:
    """Tokens of each text of an Arrow string column."""
    merger, cache = _merger(model_path)
    parts = [np.zeros(0, np.int64)]
    for lo, hi, data, offsets in ragged.slices(column, SLICE):
        data, offsets = spaced(data, offsets)
        if not len(data):
            parts.append(np.zeros(hi - lo, np.int64))
            continue
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[ragged.row_starts(offsets)] = True
        starts = np.flatnonzero(start)
        ends = np.r_[starts[1:], len(data)]
        codes, values, first = ragged.distinct(ragged.span_hash(data, starts, ends))
        raw = data.tobytes()

        def merged(new: np.ndarray, raw=raw, starts=starts[first], ends=ends[first]) -> np.ndarray:
            return merger.counts([raw[a:b].decode("utf-8").replace(" ", SPACE) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])[:, None]

        counts = cache.get(values, merged)[:, 0]
        parts.append(ragged.row_sums(counts[codes], ragged.rows_of(starts, offsets), hi - lo).astype(np.int64))
    return np.concatenate(parts)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; null text counts as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = b.column(1)
            _, offsets = ragged.buffers(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(count_column(text, model_path), pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(ragged.tidy(batches), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
