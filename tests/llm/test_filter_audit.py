import itertools
import random
import re

import numpy as np

from tessera.llm import filter_audit as A
from tessera.llm import ragged

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(doc, docs):
    text = doc[1] or ""
    words = WORDS.findall(text)
    copy = doc[0] is not None and any(d[0] is not None and d[0] < doc[0] and (d[1] or "") == text for d in docs)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    out = {}
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], fails(d, docs)) for d in docs if (d[2] or "") == part]
        taken = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                redundant = sum(d[1][f] for d in own) - len(gone)
                out[part, order, step + 1] = [len(stay), len(gone), redundant, sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                taken[f] += len(gone)
                left = stay
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                out[part, order, step + 1].append(taken[f])
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["the", "The", "a", "é", "日本", "x y", "word", "IBM", "$5", "a|b", "tail."] + [f"w{k}" for k in range(150)]
    docs = [(k, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(rnd.choice(vocab[rnd.choice([0, 3, 9]) :]) for _ in range(rnd.choice([0, 1, 30, 99, 100, 140, 300]))), rnd.choice(["en", "fr", "", None])) for k in range(120)]
    docs += [(200 + k, docs[k % 7][1], rnd.choice(["en", "de"])) for k in range(40)]  # copies
    docs += [(None, docs[3][1], "en"), (None, None, None), (5, None, "fr"), (6, "", "fr"), (3, docs[3][1], "en"), (3, "other", "en"), (900, " ".join(f"q{k % 90_000}" for k in range(100_000)), "de")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, 240, 2)] + [(4, 1, 1), (None, 1, 1), (77_777, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    # columns whose names the operator uses for its own
    for c in ("id", "part", "mask", "digest", "n"):
        df = df.withColumn(c, df.doc_id)
    got = A.audit(A.failed_filters(df), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "doc_id AS id", "1 AS good"))
    rows = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got.collect()}
    assert rows == brute(docs, labels)


def test_hashes_that_collide_are_told_apart(monkeypatch):
    texts = ["aa bb aa cc dd", "x", "", "one two one two"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    starts, ends = ragged.runs(A._WORD[data], offsets)
    rows = ragged.rows_of(starts, offsets)
    for hashes in (np.zeros(len(starts), np.uint64), A.word_hashes(data, starts, ends)):
        assert A.distinct_words(data, starts, ends, rows, 4, hashes).tolist() == [4, 1, 0, 2]


def test_blocks_change_nothing(monkeypatch):
    texts = ["A b $ " * 500, "é" * 3000, "W" * 5000, ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    whole = A.scanned(data, offsets).tolist()
    monkeypatch.setattr(A, "BLOCK", 64)
    assert A.scanned(data, offsets).tolist() == whole == [0b1110, 0b0001, 0b0101, 0b0001]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert A.audit(A.failed_filters(empty), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []
