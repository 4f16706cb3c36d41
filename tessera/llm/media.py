"""Media columns with content-defined payload chunking.

A text's payload (UTF-8, padded with zero bytes to a positive multiple of 64) is held as 8-bit
samples of a WAV file. A gear hash over the last 32 bytes cuts the file into chunks.

1. Every file gives its ordered list of chunk digests. Only digests are shuffled: of equal
   payloads one is kept, and a Spark join over digests finds chunks that several files hold;
   the first holder lends them, the others refer to them.
2. What a file must leave out or lend is joined to the texts (broadcast only if its measured
   size is below a bound, else by a shuffle), and the store is written: per file its digests,
   and the bytes of every chunk but those it refers to.
3. The store is read back: chunks referred to are joined in by digest, every chunk is checked
   against its digest, the ordered list is put together again, and the samples of the WAV file
   are decoded for features.

Null and empty texts have the payload of 64 zero bytes; equal texts, and repeated rows, get
equal values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ragged
from tessera.llm.shared import text_rows, written

UNIT = 64
RATE = 8000
HEADER = 44
LEAST, CUT_BITS, MOST = 512, 11, 8192
BROADCAST_BYTES = 32 << 20
_GEAR = np.random.RandomState(65537).randint(0, 2**32, 256, dtype=np.uint32)


def wav_header(n: int) -> bytes:
    """The header of a mono PCM file of n 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def wav_samples(media: bytes) -> np.ndarray:
    """The samples of such a file; anything else is an error."""
    n = len(media) - HEADER
    if n < 0 or media[:HEADER] != wav_header(n):
        raise ValueError("not a mono 8-bit PCM file")
    return np.frombuffer(media, np.uint8, offset=HEADER)


def media_of(texts: list[bytes]) -> list[bytes]:
    sizes = [max(UNIT, -(-len(t) // UNIT) * UNIT) for t in texts]
    return [wav_header(n) + t + bytes(n - len(t)) for t, n in zip(texts, sizes, strict=True)]


def chunk_ends(files: list[bytes]) -> list[list[int]]:
    """Where each file's chunks end: at the first place at least LEAST bytes on whose gear hash
    has CUT_BITS leading zeros, and MOST bytes on at the latest."""
    data = np.frombuffer(b"".join(files), np.uint8)
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):
        shifted = h[:-w] << np.uint32(w)
        h = h.copy()
        h[w:] += shifted
    cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, base = [], 0
    for f in files:
        own = (cuts[np.searchsorted(cuts, base + LEAST) : np.searchsorted(cuts, base + len(f))] - base).tolist()
        ends, start, k = [], 0, 0
        while start < len(f):
            while k < len(own) and own[k] < start + LEAST:
                k += 1
            end = min(own[k] if k < len(own) else len(f), start + MOST, len(f))
            ends.append(end)
            start = end
        out.append(ends)
        base += len(f)
    return out


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square about the middle, zero crossings and peak of the samples."""
    s = samples.astype(np.int64) - 128
    n = len(s)
    return f"mean={int(s.sum()) / n:.6f};rms={(int((s * s).sum()) / n) ** 0.5:.6f};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())};peak={int(np.abs(s).max())}"


def _files(column) -> Iterator[tuple[int, list[bytes], list[bytes], list[list[int]]]]:
    for lo, _hi, data, offsets in ragged.slices(column):
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        files = media_of(texts)
        yield lo, texts, files, chunk_ends(files)


def _digests(f: bytes, ends: list[int]) -> list[bytes]:
    return [hashlib.sha256(f[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)]


def _manifests(rows: DataFrame) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, texts, files, ends in _files(b.column(2)):
                some = [b.column(k).slice(lo, len(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*some, pa.array([len(t) for t in texts], pa.int64()), pa.array([_digests(f, e) for f, e in zip(files, ends, strict=True)], pa.list_(pa.binary()))], ["id", "key", "n_bytes", "digests"])

    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, key string, n_bytes bigint, digests array<binary>")


def _store(rows: DataFrame) -> DataFrame:
    """(key, digests, parts, lends) of each file that is kept: parts holds null where it refers."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            refers, lends = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, texts, files, ends in _files(b.column(1)):
                digests, parts = [], []
                for k, (f, e) in enumerate(zip(files, ends, strict=True)):
                    out = set(refers[lo + k] or ())
                    digests.append(_digests(f, e))
                    parts.append([None if n in out else f[x:y] for n, (x, y) in enumerate(zip([0, *e], e, strict=False))])
                n = len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(digests, pa.list_(pa.binary())), pa.array(parts, pa.list_(pa.binary())), pa.array([lends[lo + k] or [] for k in range(n)], pa.list_(pa.int32()))], ["key", "digests", "parts", "lends"])

    return rows.mapInArrow(batches, "key string, digests array<binary>, parts array<binary>, lends array<int>")


def _decoded(objects: DataFrame) -> DataFrame:
    """What the stored files hold, chunk by chunk verified. `filled` gives missing chunks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for r in range(b.num_rows):
                parts = b.column(2)[r].as_py()
                for x in b.column(3)[r].as_py() or ():
                    parts[x["seq"]] = x["bytes"]
                for p, d in zip(parts, b.column(1)[r].as_py(), strict=True):
                    if p is None or hashlib.sha256(p).digest() != d:
                        raise ValueError(f"a chunk of {b.column(0)[r]} is missing or damaged")
                media = b"".join(parts)
                samples = wav_samples(media)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], ["key", *FIELDS])

    return objects.select("key", "digests", "parts", "filled").mapInArrow(batches, "key string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


FIELDS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the store and returns (manifest of every row, the stored files)."""
    rows = text_rows(docs, id_col, text_col).select("id", F.sha2("text", 256).alias("key"), "text")
    manifest = written(_manifests(rows), "manifest")
    keepers = manifest.groupBy("key").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("copies"), F.first("digests").alias("digests"))
    keepers = written(keepers, "keepers")
    chunks = keepers.select("key", F.posexplode("digests").alias("seq", "digest"))
    shared = chunks.groupBy("digest").agg(F.min(F.struct("key", "seq")).alias("lender"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "lender")
    holders = chunks.join(written(shared, "shared-chunks"), "digest").withColumn("lends", F.expr("key = lender.key AND seq = lender.seq"))
    uses = holders.groupBy("key").agg(F.collect_list(F.when(~F.col("lends"), F.col("seq"))).alias("refers"), F.collect_list(F.when(F.col("lends"), F.col("seq"))).alias("lends"))
    orders = keepers.where("copies > 1").select("key", "keeper").join(uses, "key", "full")
    orders = written(orders, "orders")
    size = orders.agg(F.sum(F.lit(128) + 4 * (F.coalesce(F.size("refers"), F.lit(0)) + F.coalesce(F.size("lends"), F.lit(0))))).first()[0] or 0
    told = rows.join(F.broadcast(orders) if size <= BROADCAST_BYTES else orders, "key", "left").where("keeper IS NULL OR id <=> keeper")
    return manifest, written(_store(told.select("key", "text", "refers", "lends")), "media")


def read_media(objects: DataFrame) -> DataFrame:
    """(key, payload and media figures, feature) of the stored files."""
    lent = objects.where("size(lends) > 0").select(F.explode(F.expr("transform(lends, n -> struct(digests[n] AS digest, parts[n] AS bytes))")).alias("c")).select("c.digest", "c.bytes")
    lacking = objects.where("exists(parts, p -> p IS NULL)")
    wanted = lacking.select("key", F.posexplode("parts").alias("seq", "part"), "digests").where("part IS NULL").select("key", "seq", F.expr("digests[seq]").alias("digest"))
    filled = wanted.join(lent, "digest").groupBy("key").agg(F.collect_list(F.struct("seq", "bytes")).alias("filled"))
    whole = objects.where("NOT exists(parts, p -> p IS NULL)").select("key", "digests", "parts", F.lit(None).cast("array<struct<seq:int,bytes:binary>>").alias("filled"))
    return _decoded(whole.unionByName(lacking.join(filled, "key").select("key", "digests", "parts", "filled")))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: n_bytes, and what its stored media gives back."""
    manifest, objects = store_media(docs, id_col, text_col)
    found = written(read_media(objects).dropDuplicates(["key"]), "features")
    return manifest.select("id", "key", "n_bytes").join(found, "key").select(F.col("id").alias(id_col), "n_bytes", *FIELDS)
