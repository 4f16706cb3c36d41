import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import BytePairs, _best_fit, intervals, pack, plan

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(JSON)
ODD = ["", " ", "  ", "a'll b", "'s", "it's'street", "x''s", "d 'S 's", "<|endoftext|> a<|endoftext|>", " " * 37 + "x" + " " * 100, "a" * 1000, "\n\n x \n", "　　a  b", "①½ ²³ 12"]


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_ids_equal_the_library(ranks):
    rnd = random.Random(2)
    alphabet = "abc  \n\t\r<>/é日本𝒳eth ing ñß0129.,'\"\x00​😀''stvrelmd  \xa0　\x85\x1c①½"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(3000 if ranks else 100)]
    got = [ids[a:b].tolist() for _, _, ids, off in BytePairs(JSON, ranks).encode(pa.array(texts)) for a, b in zip(off[:-1], off[1:])]
    assert got == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_and_is_near_the_bound(seed):
    rnd = random.Random(seed)
    draw = [lambda: rnd.randrange(1, 1025), lambda: rnd.randrange(200, 420), lambda: min(1024, max(1, int(rnd.lognormvariate(5.5, 1)))), lambda: rnd.choice([1024, 3, 500, 524]), lambda: 600, lambda: rnd.randrange(1, 40)][seed]
    histogram = Counter(draw() for _ in range(4000))
    classes = plan(histogram, 1024)
    placed = Counter()
    for n, have in classes:
        assert sum(have) <= 1024 and n > 0
        for s in have:
            placed[s] += n
    assert placed == histogram
    used, bound = sum(n for n, _ in classes), -(-sum(s * n for s, n in histogram.items()) // 1024)
    assert used <= sum(n for n, _ in _best_fit(histogram, 1024)) and used >= bound
    if seed in (2, 5):
        assert used <= bound + 2
    per = defaultdict(int)
    for size, lo, hi, *_ in intervals(classes):
        assert lo == per[size]
        per[size] = hi
    assert per == histogram


def test_pieces(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice(["the", "of", "house", "zxq", "12"]) for _ in range(rnd.choice([0, 5, 200, 1023, 1024, 2500])))) for k in range(120)]
    rows += [(500, None), (501, ""), (1, rows[1][1]), (None, "no id"), (502, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, length int").repartition(5)
    got = pack(df, JSON, RANKS).collect()
    want = []
    for k, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        cut = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cut, cut[1:])):
            want.append((k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(df.limit(0), JSON, RANKS).collect() == []


def test_long_pre_tokens_that_differ_by_exchanged_stretches(spark):
    """Two words of the same letters, 16 KB stretches of which are exchanged, are two words."""
    a, b = "ab" * 8192, "cd" * 8192
    texts = [a + b, b + a, a + b + a, b + a + a]
    enc = BytePairs(JSON, RANKS)
    ids = [i for _, _, i, _ in enc.encode(pa.array(texts))]
    offsets = [o for _, _, _, o in enc.encode(pa.array(texts))][0]
    for k, want in enumerate(enc.whole(texts)):
        assert ids[0][offsets[k] : offsets[k + 1]].tolist() == want.tolist()
