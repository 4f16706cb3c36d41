import random
import re

from tessera.llm.decontaminate import best_fit, find_leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def distance(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rnd, item, n):
    w = list(item)
    for _ in range(n):
        at, how = rnd.randrange(len(w)), rnd.randrange(3)
        w[at : at + (how > 0)] = [] if how == 2 else [f"z{rnd.randrange(999)}"]
    return w


def test_bit_parallel_distance_equals_the_table():
    rnd = random.Random(3)
    for _ in range(300):
        item = [rnd.randrange(5) for _ in range(rnd.randrange(1, 90))]
        text = [rnd.randrange(5) for _ in range(rnd.randrange(0, 120))]
        assert best_fit(item, text)[0] == distance(item, text)


def test_recall_and_precision_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(12, 70)))) for k in range(40)]
    docs = []
    for k in range(300):
        text = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 200))]
        if k % 2:
            item = words(rnd.choice(items)[1])
            at = rnd.randrange(len(text) + 1)
            text[at:at] = edited(rnd, item, int(rnd.choice([0, 0, 0.05, 0.1]) * len(item)))
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(text).upper()))
    docs += [(900, None), (901, ""), (902, "!!"), (1, docs[1][1])]
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (77, None), (78, "a b")], "item_id bigint, text string")).collect()}
    true = {(d, i): distance(w, t) for d, t in ((d, words(x)) for d, x in docs) for i, w in ((i, words(x)) for i, x in items) if distance(w, t) <= int(0.2 * len(w))}
    assert set(got) <= set(true) and all(true[k] == v for k, v in got.items())
    exact = {k for k, v in true.items() if v == 0}
    assert exact <= set(got)
    assert len(got) >= 0.95 * len(true)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, item string, words int")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    assert find_leaks(none, items).collect() == []
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j")], "doc_id bigint, text string")
    assert find_leaks(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in find_leaks(docs, items).collect()] == [(1, 1, 0)]


def test_short_items_are_all_found(spark):
    rnd = random.Random(8)
    texts = [(k, " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(0, 12)))) for k in range(150)]
    items = [(k, " ".join(rnd.choice("abcdef") for _ in range(n))) for k, n in enumerate([1, 2, 2, 3, 3, 4, 4, 4])]
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(d, i) for d, x in texts for i, y in items if distance(words(y), words(x)) == 0} and len(got) > 100


def test_recall_near_the_threshold_at_all_lengths(spark):
    rnd = random.Random(12)
    vocab = [f"v{k}" for k in range(4000)]
    for low, high in ((5, 10), (12, 30), (31, 70), (100, 201)):
        items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(low, high)))) for k in range(100)]
        docs = []
        for k, text in items:
            for _ in range(3):
                item = words(text)
                around = [[rnd.choice(vocab) for _ in range(rnd.randrange(60))] for _ in range(2)]
                docs.append((len(docs), " ".join(around[0] + edited(rnd, item, int(rnd.choice([0.15, 0.2]) * len(item))) + around[1])))
        true = {(d, d // 3) for d, x in docs if distance(words(items[d // 3][1]), words(x)) <= int(0.2 * len(words(items[d // 3][1])))}
        got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
        print(low, high, len(got & true) / len(true))
        assert len(true) > 250 and len(got & true) >= 0.95 * len(true)
