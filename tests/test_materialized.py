import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import materialized as M


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_aggregates_are_those_of_the_whole_table(spark, seed):
    rnd = random.Random(seed)
    table, schema = {}, "id int, g string, cause string, cost int"

    def row(i):
        return (i, rnd.choice(["x", "x", "y", None]), rnd.choice([None, *(f"c{int(rnd.expovariate(0.15))}" for _ in range(6))]), rnd.randrange(100))

    for i in range(300):
        table[i] = row(i)
    df = lambda rows: spark.createDataFrame(list(rows), schema)
    view = M.Aggregates.of(df(table.values()), ("g",), "cause", "cost", top=3, spare=2)
    for step in range(5):
        before = df(table.values())
        new = [row(i) for i in rnd.sample(range(420), 60)]
        gone = rnd.sample(sorted(table), 50 if step != 3 else 200)
        gone = [i for i in gone if i not in {r[0] for r in new}]
        view = view.applied(M.changes(spark.createDataFrame([(i,) for i in gone] or [(-1,)], "id int"), df(new), ["id"], before))
        for i in gone:
            table.pop(i, None)
        table.update({r[0]: r for r in new})
        rows = list(table.values())
        groups = {r[1] for r in rows}
        assert {(r.g, r.n, r.total) for r in view.counts.collect()} == {(g, sum(r[1] == g for r in rows), sum(r[3] for r in rows if r[1] == g)) for g in groups}
        count = {g: Counter(r[2] for r in rows if r[1] == g and r[2]) for g in groups}
        assert {(r.g, r["values"]) for r in view.distinct().collect() if r.g is not None} == {(g, len(c)) for g, c in count.items() if g is not None and c}
        got = {}
        for r in view.best().orderBy("g", "rank").collect():
            got.setdefault(r.g, []).append((r.cause, r.n))
        for g in groups - {None}:
            assert got.get(g, []) == sorted(count[g].items(), key=lambda x: (-x[1], x[0]))[:3], (step, g)


def test_changes_of_a_batch(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    got = M.changes(spark.createDataFrame([(3,)], "k int"), spark.createDataFrame([(1, "z"), (9, "n")], "k int, v string"), ["k"], old)
    assert sorted(map(tuple, got.collect())) == [(1, "a", -1), (1, "z", 1), (3, "c", -1), (9, "n", 1)]
    assert M.changes(old, None, ["k"]).agg(F.sum("sign")).first()[0] == -3
