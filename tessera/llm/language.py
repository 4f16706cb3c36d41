"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (letters only, in lower case; U+2581 begins a
word). Each language has a probability for each piece, fitted by expectation maximisation on a
bounded sample of labelled rows. A word's probability is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words (maximal runs of
letters). The forward algorithm runs over all distinct words of a slice at once, in blocks of
columns: what the pieces that reach into the next block need is carried over and rescaled, so
that words of any length are summed over all their segmentations in bounded memory.

The sample takes about `sample` rows of each language (all of a smaller one), chosen by a hash of
the id, from rows whose crc32(id) mod 4 is not 2 and whose label is not null. Everything else covers
all rows and words.

A text that is null or has no letter is `und` with score 0; so is every text if no row is
labelled. Of languages that fit equally well the first by name is predicted. Repeated rows are
scored each; very long texts are scored whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ragged

START = "▁"
AREA = 1 << 21
BLOCK = 32
CACHE = 500_000
CHUNK = 8_000
_LETTER = None
_BASE = np.uint64(0x100000001B3)


def letter_table() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def pieces_of(model_path: str) -> list[str]:
    """The vocabulary's pieces of letters in lower case, with or without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in every if p == p.lower() and p.removeprefix(START).isalpha() or p == START})


class Words:
    """Words as one array of code points, in the order of their lengths."""

    def __init__(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(size, kind="stable")
        self.flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start, self.size = (np.cumsum(size) - size)[self.order], size[self.order]

    def codes(self, rows: slice, low: int, high: int) -> np.ndarray:
        """The characters low to high of some words, 0 outside them."""
        place = np.arange(low, high)[None, :]
        inside = (place >= 0) & (place < self.size[rows, None])
        return np.where(inside, self.flat[np.where(inside, self.start[rows, None] + place, 0)], 0).astype(np.uint64)


class Lattice:
    """Where the pieces stand in words: all segmentations of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)  # row `size` stands for a character without a piece, `size + 1` for none
        self.by_length = {}
        for n in sorted({len(p) for p in pieces}):
            ids = [i for i, p in enumerate(pieces) if len(p) == n]
            codes = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64)
            self.by_length[n] = ragged.HashIndex(self._hash(codes)), np.array(ids, np.int32)
        self.longest = max(self.by_length, default=1)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = ragged.mix(h * _BASE + codes[:, k])
        return h

    def of(self, words: Words, rows: slice, low: int, high: int) -> list[np.ndarray]:
        """For each piece length, the piece that begins at each of the places low to high."""
        codes, size = words.codes(rows, low, high + self.longest), words.size[rows, None]
        width, place = high - low, np.arange(low, high)[None, :]
        out, h = [], np.zeros((len(codes), width), np.uint64)
        for n in range(1, self.longest + 1):
            h = ragged.mix(h * _BASE + codes[:, n - 1 : n - 1 + width])
            found = np.full(h.shape, self.size + 1, np.int32)
            inside = (place >= 0) & (place + n <= size)
            if n in self.by_length:
                index, ids = self.by_length[n]
                at = index.find(h[inside])
                found[inside] = np.where(at >= 0, ids[at], self.size + 1)
            if n == 1:
                found[inside & (found > self.size)] = self.size
            out.append(found)
        return out

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """(words, languages): the logarithm of the sum over all segmentations of each word."""
        out, of, k = np.empty((len(words), p.shape[1])), Words(words), self.longest
        for begin in range(0, len(words), CHUNK):
            at, end = begin, min(begin + CHUNK, len(words))  # words at..end are longer than the columns done
            tail = np.zeros((end - at, k, p.shape[1]))  # the sums of the last k beginnings
            tail[:, -1] = 1.0
            scale, done = np.zeros((end - at, p.shape[1])), 0
            while at < end:
                width = min(BLOCK, int(of.size[end - 1]) - done)
                pieces = self.of(of, slice(at, end), done - k + 1, done + width)
                a = np.concatenate([tail, np.zeros((end - at, width, p.shape[1]))], axis=1)
                for j in range(k, k + width):
                    for n in range(1, k + 1):
                        a[:, j] += a[:, j - n] * p[pieces[n - 1][:, j - n]]
                over = int(np.searchsorted(of.size[at:end], done + width, "right"))
                rows = np.arange(over)
                out[of.order[at : at + over]] = np.log(a[rows, k - 1 + of.size[at : at + over] - done]) + scale[:over]
                tail = a[over:, -k:]
                most = tail.max(axis=1)
                tail, scale = tail / most[:, None], scale[over:] + np.log(most)
                at, done = at + over, done + width
        return out

    def expected(self, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in words that occur `times`, for one language p. Sums are kept within
        range by a logarithm of their own for each column, so words may be of any length."""
        counts, every, p, k = np.zeros(self.size + 2), Words(words), p.ravel(), self.longest
        lo = 0
        while lo < len(words):
            hi = min(lo + CHUNK, len(words))
            while hi > lo + 1 and (hi - lo) * int(every.size[hi - 1]) > AREA:
                hi = lo + (hi - lo) // 2
            rows = slice(lo, hi)
            size, each = every.size[rows], np.arange(hi - lo)
            width = int(size[-1])
            at = self.of(every, rows, 0, width)
            a, b = np.zeros((len(each), width + 1)), np.zeros((len(each), width + 1))
            log_a, log_b = np.zeros(a.shape), np.zeros(b.shape)
            a[:, 0] = b[each, size] = 1.0
            for j in range(1, width + 1):
                log_a[:, j] = log_a[:, j - 1]
                for n in range(1, min(j, k) + 1):
                    a[:, j] += a[:, j - n] * p[at[n - 1][:, j - n]]
                if j % k == 0:
                    _within_range(a, log_a, slice(max(0, j - k + 1), j + 1))
            for j in range(width - 1, -1, -1):
                log_b[:, j] = log_b[:, j + 1]
                for n in range(1, min(k, width - j) + 1):
                    b[:, j] += p[at[n - 1][:, j]] * b[:, j + n]
                if (width - j) % k == 0:
                    _within_range(b, log_b, slice(j, min(width, j + k - 1) + 1))
            scale, whole = times[every.order[rows]] / a[each, size], log_a[each, size][:, None]
            for n in range(1, min(k, width) + 1):
                pid = at[n - 1][:, : width - n + 1]
                far = np.exp(np.minimum(log_a[:, : width - n + 1] + log_b[:, n:] - whole, 700))
                counts += np.bincount(pid.ravel(), weights=(a[:, : width - n + 1] * p[pid] * b[:, n:] * far * scale[:, None]).ravel(), minlength=self.size + 2)
            lo = hi
        return counts


def _within_range(sums: np.ndarray, logs: np.ndarray, columns: slice) -> None:
    """Divides the columns that later ones build on by the largest of each row, and notes the logarithm."""
    most = sums[:, columns].max(axis=1)
    most[most == 0] = 1.0
    sums[:, columns] /= most[:, None]
    logs[:, columns] += np.log(most)[:, None]


def fit(lattice: Lattice, words: list[str], times: np.ndarray, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """The probabilities of the pieces (and of an unknown character) in one language."""
    p = np.full(lattice.size + 2, 1.0 / (lattice.size + 1))
    p[-1] = 0.0
    for _ in range(rounds):
        c = lattice.expected(words, times, p)
        c[:-1] += smooth
        c[-1] = 0.0
        p = c / c.sum()
    p[lattice.size] = 1e-7  # an unknown character tells nothing about the language
    return p


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ragged.runs(ragged.byte_classes(data, letter_table()), offsets)


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, times) of labelled texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs = b.column(0).to_pylist()
            total: dict[tuple, int] = {}
            for lo, _hi, data, offsets in ragged.slices(b.column(1)):
                starts, ends = word_spans(data, offsets)
                raw, row = data.tobytes(), ragged.rows_of(starts, offsets)
                for r, a, z in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    key = langs[lo + r], raw[a:z]
                    total[key] = total.get(key, 0) + 1
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1].decode().lower() for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "times"])

    return rows.select("lang", "text").mapInArrow(ragged.tidy(batches), "lang string, word string, times bigint").groupBy("lang", "word").agg(F.sum("times").alias("times"))


class Model:
    """Languages, pieces and the log-probabilities of words."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p


def train(docs: DataFrame, model_path: str, sample: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits each language on about `sample` of its rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(~_held_out("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    pieces = pieces_of(model_path)
    if not counts:
        return Model([], pieces, np.zeros((len(pieces) + 2, 0)))
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))))
    taken = rows.where((F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1e6) < share[F.col("lang")])
    got = _word_counts(taken).toArrow().to_pandas()
    lattice, languages, fitted = Lattice(pieces), sorted(counts), []
    for lang in languages:
        of = got[got["lang"] == lang]
        words, times = [START + w for w in of["word"]], of["times"].to_numpy(float)
        fitted.append(fit(lattice, words or [START], times if words else np.ones(1)))
    return Model(languages, pieces, np.stack(fitted, axis=1))


def _held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class Scorer:
    """Predictions for the texts of Arrow columns, with a bounded cache of words."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.p, self.lattice = languages, p, Lattice(pieces)
        self.cache = ragged.Cache(CACHE, len(languages), np.float64)

    def _words(self, raw: bytes, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log-probabilities of distinct words."""

        def logs(new: np.ndarray) -> np.ndarray:
            return self.lattice.log_probability([START + raw[a:z].decode().lower() for a, z in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], self.p)

        return self.cache.get(values, logs)

    def __call__(self, column) -> tuple[list[str], list[float]]:
        pred: list[str] = []
        score: list[float] = []
        for lo, hi, data, offsets in ragged.slices(column):
            n = hi - lo
            starts, ends = word_spans(data, offsets)
            if not len(starts) or not self.languages:
                pred += ["und"] * n
                score += [0.0] * n
                continue
            codes, values, first = ragged.distinct(ragged.span_hash(data, starts, ends))
            logs, row = self._words(data.tobytes(), values, starts[first], ends[first])[codes], ragged.rows_of(starts, offsets)
            total = np.stack([ragged.row_sums(logs[:, k], row, n) for k in range(len(self.languages))], axis=1)
            empty = np.bincount(row, minlength=n) == 0
            weight = np.exp(total - total.max(axis=1, keepdims=True))
            best = total.argmax(axis=1)
            sure = weight[np.arange(n), best] / weight.sum(axis=1)
            pred += ["und" if e else self.languages[k] for e, k in zip(empty.tolist(), best.tolist(), strict=True)]
            score += np.where(empty, 0.0, sure).tolist()
        return pred, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; score is the language's posterior."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in it:
            pred, score = scorer(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(ragged.tidy(batches), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), _held_out("id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose predicted language has a score above least_score, with all their
    columns; a null language becomes the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in it:
            pred, score = scorer(b.column(text_at))
            keep = pa.array([x != "und" and y > least_score for x, y in zip(pred, score, strict=True)], pa.bool_())
            lang = pa.array([x if y is None else y for x, y in zip(pred, b.column(lang_at).to_pylist(), strict=True)], b.schema.field(lang_at).type)
            yield pa.RecordBatch.from_arrays([lang if k == lang_at else b.column(k) for k in range(b.num_columns)], schema=b.schema).filter(keep)

    return docs.mapInArrow(ragged.tidy(batches), docs.schema)


def language_id(docs: DataFrame, model_path: str, sample: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(docs, train(docs, model_path, sample, id_col, text_col, lang_col), id_col, text_col)
