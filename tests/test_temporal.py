import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import temporal as A
from tessera.operators.graph import PropertyGraph

DAY = dt.datetime(2024, 1, 1)


def test_as_of_against_a_loop(spark):
    rnd = random.Random(4)
    when = lambda: DAY + dt.timedelta(minutes=rnd.randrange(0, 20_000, 10))
    states = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), w := when(), rnd.choice([None, w + dt.timedelta(minutes=rnd.randrange(1, 3000))]), n, f"s{n}") for n in range(400)]
    times = [(k, rnd.choice(["hot"] * 5 + ["a", "b", "none", None]), rnd.choice([None] + [when()] * 9)) for k in range(500)]
    s = spark.createDataFrame(states + [("hot", None, None, 999, "never")], "k string, since timestamp, until timestamp, n int, what string")
    t = spark.createDataFrame(times, "id int, k string, at timestamp")
    for until in (None, "until"):
        got = {r.id: r.what for r in A.as_of(t, s, "k", "at", "since", until=until, order="n").collect()}
        assert len(got) == len(times)
        for i, key, at in times:
            held = max(((x[1], x[3], x) for x in states if key is not None and at is not None and x[0] == key and x[1] <= at), default=None)
            want = held and (held[2][4] if until is None or held[2][2] is None or held[2][2] > at else None)
            assert got[i] == want, (i, key, at)


def test_intervals_and_graph_as_of(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    h = spark.createDataFrame([("k", d(0), 1), ("k", d(2), 2), ("j", d(1), 3)], "k string, at timestamp, v int")
    assert {(r.k, r.v, r.valid_to) for r in A.intervals(h, "k", "at").collect()} == {("k", 1, d(2)), ("k", 2, None), ("j", 3, None)}
    nodes = spark.createDataFrame([("A", x, x, None, None) for x in "abcd"], "label string, business_key string, title string, created_at timestamp, updated_at timestamp")
    edges = spark.createDataFrame([("A", "a", "R", "A", "b", d(0), d(5), d(3)), ("A", "b", "R", "A", "c", None, None, None), ("A", "c", "R", "A", "d", d(4), None, d(4))], "from_label string, from_key string, rel_type string, to_label string, to_key string, valid_from timestamp, valid_to timestamp, confirmed_at timestamp")
    g = PropertyGraph(nodes, edges)
    reach = lambda n, **k: {r.business_key for r in g.as_of(F.lit(d(n)), **k).neighbourhood("A", "a", 3).collect()}
    assert reach(1) == {"a", "b", "c"} and reach(4) == {"a", "b", "c", "d"} and reach(5) == {"a"} and reach(4, confirmed=True) == {"a", "b"}


def best_paths(nodes, edges, centre, depth):
    """Highest products over at most depth steps, by steps of dynamic programming over all nodes."""
    best = {centre: (1.0, 0)}
    for step in range(1, depth + 1):
        new = dict(best)
        for a, b, c in edges + [(b, a, c) for a, b, c in edges]:
            if a in best and b in nodes:
                found = (best[a][0] * c, -step)
                if b not in new or found > (new[b][0], -new[b][1]):
                    new[b] = (found[0], step)
        best = new
    return sorted(((n, c, h) for n, (c, h) in best.items()), key=lambda x: (-x[1], x[2], x[0]))


def test_best_first_expansion_is_the_cut_of_all_paths(spark):
    rnd = random.Random(9)
    names = [f"n{k:02}" for k in range(60)]
    own = {n: rnd.choice([None, 0.2, 0.9]) for n in names} | {"n00": 1.0}
    edges = [(rnd.choice(names), rnd.choice(names), rnd.choice([1.0, 0.9, 0.5, 0.5, 0.1])) for _ in range(140)]
    g = PropertyGraph(
        spark.createDataFrame([("A", n, n, c) for n, c in own.items()], "label string, business_key string, title string, confidence double"),
        spark.createDataFrame([("A", a, "R", "A", b, None if c == 1.0 else c) for a, b, c in edges], "from_label string, from_key string, rel_type string, to_label string, to_key string, confidence double"),
    )
    for depth, most, least in ((0, 5, 0.0), (1, 3, 0.0), (3, 10, 0.0), (4, 25, 0.5), (2, 200, 0.5)):
        nodes, induced = g.confident("A", "n00", depth, most, least)
        allowed = {n for n, c in own.items() if c is None or c >= least}
        want = best_paths(allowed, edges, "n00", depth)[:most]
        got = [(r.business_key, round(r.confidence, 9), r.hops) for r in nodes.orderBy(F.desc("confidence"), "hops", "business_key").collect()]
        assert got == [(n, round(c, 9), h) for n, c, h in want]
        kept = {n for n, *_ in want}
        assert induced.count() == sum(a in kept and b in kept for a, b, _ in edges)
    assert g.confident("A", "missing", 2)[0].count() == 0
    out = {b for a, b, _ in edges if a == "n01"}
    assert {r.business_key for r in g.neighbours("A", "n01", "out", depth=1).collect()} == out - {"n01"}
    assert g.neighbours("A", "n01", "both", ["X"]).count() == 0 and g.neighbours("A", "n01", "both", depth=2, limit=3).count() == 3
