import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import components as C
from tessera.operators import ranking as R
from tessera.operators import similar as S


def texts(rnd, n):
    vocab = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(k, " ".join(rnd.choices(vocab, weights, k=rnd.choice([0, 3, 20, 20, 200])))) for k in range(n)] + [(9001, None), (9002, "w1 w1 w1"), (9003, "w1 w1 w1")]


def bm25(rows, query, k):
    docs = {i: Counter((t or "").lower().split()) for i, t in rows}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(w for d in docs.values() for w in d)
    scores = {}
    for i, d in docs.items():
        hit = [w for w in set(query.lower().split()) if w in d]
        if hit:
            scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (R.K1 + 1) / (d[w] + R.K1 * (1 - R.B + R.B * sum(d.values()) / mean)) for w in hit), 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_search_scores_as_if_all_blocks_were_read(spark, tmp_path):
    rnd = random.Random(1)
    rows = texts(rnd, 900)
    df = spark.createDataFrame(rows, "id int, text string")
    index = R.text_index(df, size=20)
    queries = [(0, "w1 w250 W250"), (1, "w0"), (2, "nothing here"), (3, ""), (4, " ".join(f"w{k}" for k in range(40))), (5, "w299 w298"), (6, None)]
    asked = spark.createDataFrame(queries, "query int, text string")
    want = {q: bm25(rows, t or "", 7) for q, t in queries}
    for ix in (index,):
        got = {}
        for r in R.search(ix, asked, 7).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.id, r.score))
        for q, _ in queries:
            assert [x[0] for x in got.get(q, [])] == [x[0] for x in want[q]] and [x[1] for x in got.get(q, [])] == pytest.approx([x[1] for x in want[q]], abs=2e-6)
    told = {r.query: (r.blocks, r.scored) for r in R.skipped(index, asked, 7).collect()}
    assert sum(s for _, s in told.values()) < 0.7 * sum(b for b, _ in told.values()), told
    index.save(str(tmp_path / "ix"))
    terms = asked.select(F.explode(R.words(F.col("text"))).alias("term"))
    again = R.search(R.TextIndex.load(spark, str(tmp_path / "ix"), terms), asked, 7)
    assert sorted((r.query, r.id, r.rank) for r in again.collect()) == sorted((q, i, k + 1) for q, x in want.items() for k, (i, _) in enumerate(x))


def test_empty_index(spark):
    index = R.text_index(spark.createDataFrame([], "id int, text string"))
    assert R.search(index, spark.createDataFrame([(1, "a")], "query int, text string")).collect() == []


@pytest.mark.parametrize("block", [R.VECTOR_BLOCK, 7])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(R, "VECTOR_BLOCK", block)
    rng = np.random.RandomState(3)
    m = rng.randn(400, 6).round(2)
    m[50:60] = m[0]
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(1000, None), (1001, [0.0] * 6), (1002, [1.0])]
    v = spark.createDataFrame(rows, "id int, vector array<double>").repartition(5)
    got = {}
    for r in R.nearest(v, v.where("id % 20 = 0 AND id < 400").withColumnRenamed("id", "query"), 12).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 400, 20):
        score = [(k, round(float(s), 6)) for k, s in enumerate(unit @ unit[q])] + [(1000, 0.0), (1001, 0.0), (1002, 0.0)]
        assert got[q] == sorted(score, key=lambda x: (-x[1], x[0]))[:12]
    assert R.nearest(v, v.where("false").withColumnRenamed("id", "query")).collect() == []


def test_entities_are_merged(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST", 40)
    rng = np.random.RandomState(5)
    centres = rng.randn(300, 32)
    rows, home = [], []
    for k in range(1800):
        c = 0 if k % 3 == 0 else rng.randint(300)  # one entity holds a third of all rows
        v = centres[c] + rng.randn(32) * rng.choice([0.0, 0.15, 0.3])
        rows.append((k, (v * rng.choice([1, 2.5])).tolist()))
        home.append(v / np.linalg.norm(v))
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [0.0] * 32)]
    got = {r.id: (r.component, r.copies) for r in S.similar_entities(spark.createDataFrame(rows, "id int, vector array<double>"), least=0.9, recall=0.99).collect()}
    m = np.array(home)
    near = m @ m.T >= 0.9
    label = np.arange(len(m))
    while True:  # all pairs, by brute force
        new = np.where(near, label[None, :], len(m)).min(1)
        if (new == label).all():
            break
        label = new
    pairs, linked = np.argwhere(np.triu(near, 1)), 0
    for a, b in pairs:
        linked += got[a][0] == got[b][0]
    assert linked >= 0.98 * len(pairs), linked / len(pairs)
    assert all(label[got[k][0]] == label[k] for k in range(len(m))), "nothing is merged that is not linked"
    assert [got[k] for k in (5000, 5001, 5002)] == [(5000, 1), (5001, 1), (5002, 1)]
    assert S.tables_for(0.99, 0.9, 8) > S.tables_for(0.9, 0.9, 8) >= 1


def test_components_and_chains(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(130)] + [(7, k) for k in range(500, 560)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, C.components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert {x: got.get(x, x) for x in label} == label
    links = [(k, k + 1) for k in range(1000, 1200)] + [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (5, 7), (0, 9), (8, 9), (None, 3)]
    got = {r.node: (r.chain, r.place, r.cyclic) for r in C.chains(spark.createDataFrame(links, "source int, target int"), spark.createDataFrame([(77,)], "node int")).collect()}
    assert all(got[1000 + k] == (1000, k, False) for k in range(201))
    assert all(got[k] == (None, None, True) for k in (1, 2, 3, 4)) and got[6] == (5, 1, False) and got[9] == (0, 1, False) and got[8] == (8, 0, False) and got[77] == (77, 0, False)
    moved = C.latest_keys(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("p", "q"), ("q", "p")], "old_key string, new_key string"))
    assert {tuple(r) for r in moved.collect()} == {("a", "c", 2), ("b", "c", 1), ("x", "c", 1), ("p", "p", None), ("q", "q", None)}


def test_a_small_cycle_costs_no_rounds_of_all_nodes(spark, monkeypatch):
    sizes, plain = [], C.checkpointed
    monkeypatch.setattr(C, "checkpointed", lambda df: sizes.append((out := plain(df)).count()) or out)
    links = [(4 * k + j, 4 * k + j + 1) for k in range(2000) for j in range(3)] + [(9000, 9001), (9001, 9002), (9002, 9000), (9002, 9003)]
    got = {r.node: (r.chain, r.place, r.cyclic) for r in C.chains(spark.createDataFrame(links, "source int, target int")).collect()}
    assert all(got[4 * k + j] == (4 * k, j, False) for k in range(2000) for j in range(4)) and all(got[k] == (None, None, True) for k in range(9000, 9004))
    assert sizes[0] == len(got) and sum(sizes[1:]) < 1.5 * sizes[0] and len(sizes) <= 5, sizes


def test_an_index_of_the_words_asked_for_weighs_as_the_whole(spark):
    df = spark.createDataFrame(texts(random.Random(4), 300), "id int, text string")
    asked = spark.createDataFrame([(0, "w1 w250 nothing"), (1, "w0 w0")], "query int, text string")
    whole, part = R.text_index(df, size=20), R.text_index(df, size=20, asked=R.query_terms(asked))
    wanted = whole.postings.where("term IN ('w0', 'w1', 'w250')")
    rows = lambda x: sorted((r.term, r.block, r.id, r.weight) for r in x.collect())
    assert rows(part.postings) == rows(wanted) and part.postings.count() < whole.postings.count() / 2
    assert rows(R.search(part, asked).selectExpr("query AS term", "rank AS block", "id", "score AS weight")) == rows(R.search(whole, asked).selectExpr("query AS term", "rank AS block", "id", "score AS weight"))


def test_scores_of_few_vectors_are_held_at_a_time(spark):
    most = lambda: R.VECTOR_ROWS * R.VECTOR_BLOCK * 8
    assert most() <= 32 << 20
    v = spark.range(3000).selectExpr("id", "array(cast(id % 7 as double), 1D) AS vector").coalesce(1)
    got = [(r.id, r.score) for r in R.nearest(v, v.where("id = 0").withColumnRenamed("id", "query"), 3).orderBy("rank").collect()]
    assert got == [(0, 1.0), (7, 1.0), (14, 1.0)]


@pytest.mark.parametrize("small", [False, True])
def test_many_queries_score_as_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("VECTOR_BLOCK", 7), ("VECTOR_ROWS", 16), ("QUERY_WORDS", 90), ("DENSE_WORDS", 3), ("ADDED", 10)):
            monkeypatch.setattr(R, name, value)
    rows = texts(random.Random(8), 300) + [(9004, "W1 nobody-asks"), (9005, "...")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    queries = [(q, t) for q, t in rows if q % 15 == 0] + [(9004, "W1 w0"), (9006, None), (9007, "nothing here")]
    asked = spark.createDataFrame(queries, "query int, text string")
    got = {}
    for r in R.search_all(df, asked, 7).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    for q, t in queries:
        want = bm25([(i, (x or "").replace("-", " ").replace(".", " ")) for i, x in rows], t or "", 7)
        assert [x[0] for x in got.get(q, [])] == [x[0] for x in want] and [x[1] for x in got.get(q, [])] == pytest.approx([x[1] for x in want], abs=2e-6), q
    named = R.search_all(df.selectExpr("concat('d', id) AS id", "text"), asked.selectExpr("concat('q', query) AS query", "text"), 7)
    want = {(f"q{q}", r[1]) for q, x in got.items() for r in x}
    assert {(r.query, r.score) for r in named.collect()} == want
    assert R.search_all(df, asked.where("false")).collect() == [] and R.search_all(df.where("false"), asked).collect() == []


def test_rank_fusion_does_not_shuffle_scores_of_all_pairs(spark, tmp_path):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)]
    d = spark.createDataFrame([(k, " ".join(rnd.choices(vocabulary, k=60))) for k in range(3000)], "doc_id long, text string").coalesce(2)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3000).selectExpr("id AS vec_id", "array(cast(id % 7 as float), 1F) AS embedding").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    shuffled = lambda: sum((s := stages.apply(k)).shuffleWriteRecords() for stages in [store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())] for k in range(stages.size()))
    before = shuffled()
    from tessera.plans.ranking_queries import rank_fusion

    assert rank_fusion(spark, str(tmp_path)).count() == 300
    assert shuffled() - before < 3000 * 30 / 2, "fewer than half of the pairs"
