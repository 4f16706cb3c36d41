import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import media


def payload(text):
    t = (text or "").encode()
    return t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))


def test_chunks_cover_files_and_survive_insertions():
    rnd = random.Random(1)
    a = bytes(rnd.randrange(256) for _ in range(60_000))
    b = a[:20_000] + b"xyz" + a[20_000:]
    cut = [media.chunk_ends([x])[0] for x in (a, b)]
    for x, ends in zip((a, b), cut, strict=True):
        sizes = [j - i for i, j in zip([0, *ends], ends, strict=False)]
        assert ends[-1] == len(x) and all(media.LEAST <= s <= media.MOST for s in sizes[:-1])
    parts = [set(media._digests(x, e)) for x, e in zip((a, b), cut, strict=True)]
    assert len(parts[0] & parts[1]) >= 0.7 * len(parts[0])
    assert media.chunk_ends([b"q" * 700, a])[1] == cut[0]  # what stands before a file doesn't matter


def test_round_trip(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh é日 ") for _ in range(40_000))
    rows = [(1, long), (2, long[:9000] + "?" + long[9000:]), (3, long[10_000:]), (4, None), (5, ""), (6, "x" * 64), (7, "x" * 65), (8, long), (9, "short"), (10, "short"), (9, "short"), (4, "other text"), (None, "no id")]
    rows += [(100 + k, long[k * 100 : k * 100 + 20_000]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))
    got = sorted(map(tuple, media.media_columns(df).collect()), key=str)
    want = []
    for k, t in rows:
        p = payload(t)
        m = media.wav_header(len(p)) + p
        want.append((k, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(media.wav_samples(m))))
    assert got == sorted(want, key=str)
    _, objects = media.store_media(df)
    stored = objects.select(F.explode("parts").alias("p")).agg(F.sum(F.length("p"))).first()[0]
    assert stored < 0.35 * sum(len(payload(t)) for _, t in rows)


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
