import random
import re

import numpy as np
import pytest

from tessera.llm import ragged
from tessera.llm import substring_dedup as S

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    """(n_words, n_removed, kept) of each row: ids in order, null first, rows of one id by their texts' hash."""
    order = sorted({(d[0] is not None, d[0] or 0, d[2], d[1] or "") for d in docs})
    seen, out = {}, {}
    for key in order:
        words = WORDS.findall(key[3])
        gone = set()
        for i in range(len(words) - S.LEAST + 1):
            window = tuple(words[i : i + S.LEAST])
            if window in seen:
                gone |= set(range(i, i + S.LEAST))
            seen.setdefault(window, (key, i))
        out[key] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return [(d[0], *out[d[0] is not None, d[0] or 0, d[2], d[1] or ""]) for d in docs]


def corpus(rnd):
    word = lambda: rnd.choice(["the", "of", "a", "é", "日本", "x."]) if rnd.random() < 0.4 else f"w{rnd.randrange(400)}"
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(n) for n in (19, 20, 21, 30, 55, 80, 200)]
    common, phrase = fresh(60), fresh(S.KGRAM)
    docs = []
    for k in range(260):
        t = fresh(rnd.choice([0, 3, 19, 20, 40, 120]))
        for _ in range(rnd.randrange(3)):
            t += rnd.choice(passages) + fresh(rnd.randrange(25))
        if k % 3 == 0:
            t += common + fresh(rnd.randrange(5))
        if k % 2 == 0:
            t = fresh(14) + phrase + fresh(14) + t  # one phrase in many contexts
        docs.append(t)
    near = docs[9] + fresh(30)
    for _ in range(40):
        t = list(near)
        for _ in range(2):
            t[rnd.randrange(len(t))] = word()
        docs.append(t)
    docs += [docs[5], docs[5], ["tick"] * 90, ["tick", "tock"] * 40, passages[5] * 3, [f"n{k}" for k in range(30_000)] + passages[6]]
    rnd.shuffle(docs)
    rows = [(k * 3, rnd.choice([" ", "\n", " \t"]).join(t)) for k, t in enumerate(docs)]
    rows += [(None, " ".join(passages[4])), (None, None), (0, " ".join(passages[6])), (0, " ".join(passages[6] + ["more"])), (9, None), rows[7], rows[7], (10**12, "  ")]
    return rows


@pytest.mark.parametrize(("hot", "shard"), [(S.HOT, S.SHARD), (3, 300)])
def test_against_brute_force(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD", shard)
    rows = corpus(random.Random(11))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("id", "d", "th", "h", "words", "gone"):  # columns whose names the operator uses for its own
        df = df.withColumn(c, df.doc_id)
    hashes = {r[0]: r[1] for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    got = S.without_repeats(df.repartition(7)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept")) for r in got), key=str) == sorted(brute([(*r, hashes[r[1] or ""]) for r in rows]), key=str)
    for r in got:
        spans = [tuple(s) for s in r["spans"]]
        assert sum(e - s for s, e in spans) == r["n_removed"]
        assert all(e - s >= S.LEAST for s, e in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_matching_statistics():
    rnd = random.Random(2)
    reference, held = S.Automaton(), []
    for _ in range(60):
        s = [rnd.randrange(3) for _ in range(rnd.randrange(1, 30))]
        subs = {tuple(h[i:j]) for h in held for i in range(len(h)) for j in range(i + 1, len(h) + 1)}
        assert reference.matched(s) == [max([n for n in range(i + 2) if n == 0 or tuple(s[i + 1 - n : i + 1]) in subs]) for i in range(len(s))]
        reference.add(s)
        held.append(s)


def test_equal_windows_have_equal_anchors_and_stretches_cover_all_windows():
    rnd = random.Random(6)
    texts = [[rnd.choice("abcdef") for _ in range(rnd.choice([0, 5, 19, 20, 33, 400]))] for _ in range(50)]
    data = np.frombuffer("".join("".join(w + " " for w in t) for t in texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(2 * len(t) for t in texts)])
    starts, ends, at = S.words_of(data, offsets)
    row, start, n, anchor, print_ = S.stretches(S.word_hashes(data, starts, ends), at)
    of_window, of_stretch, covered = {}, {}, [set() for _ in texts]
    for r, s, k, a, p in zip(row, start, n, anchor, print_, strict=True):
        assert 1 <= k <= S.STEPS
        assert of_stretch.setdefault((a, p), texts[r][s : s + k + S.LEAST - 1]) == texts[r][s : s + k + S.LEAST - 1]
        for i in range(s, s + k):
            assert i not in covered[r]
            covered[r].add(i)
            assert of_window.setdefault(tuple(texts[r][i : i + S.LEAST]), a) == a
    assert [len(c) for c in covered] == [max(0, len(t) - S.LEAST + 1) for t in texts]


def test_blocks_change_nothing(monkeypatch):
    texts = ["a é " * 300, "", "word " * 40, " x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    starts, ends, at = S.words_of(data, offsets)
    keep = np.arange(len(starts)) % 3 > 0
    whole = S._kept(data, starts, ends, keep, at).to_pylist()
    monkeypatch.setattr(S, "BLOCK", 50)
    assert S._kept(data, starts, ends, keep, at).to_pylist() == whole
    assert whole[0].split() == [w for k, w in enumerate(texts[0].split()) if k % 3] and whole[1] == ""
    assert ragged.rows_of(starts, offsets)[-1] == 3


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
