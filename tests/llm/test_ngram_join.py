import random
import re

import numpy as np

from tessera.llm import ngram_join
from tessera.llm.ngram_join import _packed, ngram_jaccard_join, parity

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            c = len(s & sets[j])
            if c and 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), k), k)
    return sorted((k, len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows))


def result(df):
    return sorted(tuple(r) for r in ngram_jaccard_join(df).collect())


def varied(rnd, n):
    vocab = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randrange(1, 160))] for _ in range(max(1, n // 8))]
    common = [f"c{k}" for k in range(50)]
    rows = []
    for k in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = common
        rows.append((k * 3 + 1, rnd.choice([" ", "\n", "  \t"]).join(w)))
    return rows


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = varied(rnd, 400) + [(5000, None), (5001, ""), (5002, "  \n"), (5003, "One two"), (5004, "one TWO"), (5005, "one two three four"), (5006, "É é"), (5007, "é é")]
    rows += [(r[0] + 10_000, r[1]) for r in rows[:20]] + rows[:5]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_a_pivots_answers_settle_pairs(spark, monkeypatch):
    """Groups of near copies and all documents: what the pivots' answers leave to compare, against a run without them."""
    rnd = random.Random(10)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(150)]
        for k in range(60):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 6])):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            rows.append((10_000 + 100 * g + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()
    compared, real = [], ngram_join._verified

    def counting(pairs, texts, n):
        compared.append(pairs.count())
        return real(pairs, texts, n)

    monkeypatch.setattr(ngram_join, "_verified", counting)
    with_answers, first = result(df), list(compared)
    compared.clear()
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    assert result(df) == with_answers
    assert len(first) > 1 and sum(first) < 0.5 * sum(compared), (first, compared)


def test_rows_without_an_id_link_with_nothing(spark):
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(5, text), (None, text), (None, text + " more"), (6, text + " more")], "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.component_id) for r in ngram_jaccard_join(df).collect()), key=str) == [(5, 5), (6, 5), (None, None), (None, None)]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, n int, component string, id string")
    assert result(df) == []
    df = spark.createDataFrame([(2, "a b", 1, "x", "y"), (7, "a b", 1, None, "y")], "doc_id bigint, text string, n int, component string, id string")
    assert result(df) == [(2, 1, 2), (7, 1, 2)]


def test_documents_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_a_task_that_is_run_again_packs_the_same(spark):
    rnd = random.Random(3)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(7 + k, f"{base} x{k % 5}") for k in range(200)]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def packed():
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
        return sorted(tuple(r) for r in _packed(df, 5, 80, *none, 1_000_000).collect())

    first = packed()
    assert any(r[0] < 0 for r in first)
    assert packed() == first


def test_long_words_that_differ_by_exchanged_stretches_are_not_linked(spark):
    a, b = "a" * 16384, "b" * 16384
    rows = [(1, a + b), (2, b + a), (3, a + b), (4, "x " * 3 + a + b + " y"), (5, "x " * 3 + b + a + " y")]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_maps_bound_long_and_short_sets():
    rng = np.random.RandomState(4)
    for n in (1, 5, 100, 128, 129, 700, 5000):
        s = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        for changed in (0, 1, n // 10, n):
            t = np.unique(np.r_[s[changed:], rng.randint(0, 2**62, changed).astype(np.uint64)])
            x, y = parity(s), parity(t)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            differ = sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y)
            assert differ <= len(np.setxor1d(s, t))
            assert changed < n or n < 100 or 180 * differ > 20 * (len(s) + len(t))  # unrelated sets are told apart at any size
