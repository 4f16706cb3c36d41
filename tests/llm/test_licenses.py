import random
import re

import duckdb

from tessera.llm.licenses import PHRASES, TEMPLATES, duckdb_sql, needed, scan_licenses, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPAN = max(len(words_of(t)) for _, t in TEMPLATES)


def brute(doc_id, text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = {label: [k for k in range(len(w)) if w[k : k + len(p)] == p] for label, p in ((x, words_of(y)) for x, y in PHRASES.items())}
    base = {x for x in at if at[x]}
    more, best = set(), 0.0
    for label, t in TEMPLATES:
        s = set(words_of(t))
        top = max((len(s & set(w[k : k + 2 * SPAN])) for k in range(0, len(w), SPAN)), default=0)
        if top >= needed(len(s), 0.85):
            more.add(label)
            best = max(best, top / len(s))
    every = sorted(x for v in at.values() for x in v)
    return doc_id, len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if every else best


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    common = "under the license of this work free mit version 2 copy or and software by cc general public".split()
    rows = []
    for k in range(300):
        w = [rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(0, 300))]
        for _ in range(rnd.randrange(3)):
            t = TEMPLATES[rnd.randrange(len(TEMPLATES))][1].split()
            if rnd.random() < 0.4:
                t[rnd.randrange(len(t))] = "edited"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((k, rnd.choice([" ", "\n", ", "]).join(w)))
    rows += [(900, None), (901, ""), (902, "?!"), (903, "CC BY-NC cc by nc"), (904, "É under the MIT license É"), (1, rows[1][1]), (None, "cc by nc")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, row int, word string")
    got = sorted(map(tuple, scan_licenses(df).collect()), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)
    assert scan_licenses(df.limit(0)).collect() == []


def test_equals_its_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    documents = duckdb.read_parquet(path)  # noqa: F841
    want = sorted(duckdb.sql(duckdb_sql()).fetchall())
    assert sorted(map(tuple, scan_licenses(spark.read.parquet(path)).collect())) == want
