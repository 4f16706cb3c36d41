import random

import corpus_pipeline
from tessera.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_rows(spark, tmp_path):
    rnd = random.Random(6)
    vocab = ["the", "of", "and", "house", "river", "stone", "green", "walk", "morning", "letter", "window", "garden", "paper", "silver", "table", "voice"]
    words = lambda n: [rnd.choice(vocab) + rnd.choice(["", "s", "ly", "ed"]) for _ in range(n)]
    items = [(k, " ".join(words(25))) for k in range(5)]
    base = words(100)
    near = list(base)
    near[50] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, "123 !!"), (5, None), (6, ""), (7, " ".join(words(20) + items[2][1].split() + words(20))), (8, " ".join(words(40)) + " mail a.b@c.de or +1 (555) 555-1234"), (9, " ".join(words(1500)))]
    df = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = df, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == df.columns
            kept.append(sorted(r.doc_id for r in out.collect()))
        docs, last = out, docs
    assert kept == [[1, 2, 3, 7, 8, 9], [1, 7, 8, 9], [1, 8, 9], [1, 8, 9]]
    text = {r.doc_id: r for r in last.collect()}
    assert text[8].text.endswith(" mail [EMAIL] or [PHONE]") and text[8].n_chars == len(text[8].text)
    places = {}
    for r in docs.collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_on_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_rows_with_shared_or_no_ids_are_told_apart_by_their_texts(spark, tmp_path):
    rnd = random.Random(9)
    vocab = ["the", "of", "and", "house", "river", "stone", "green", "walk", "morning", "letter", "window", "garden"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(60)) for _ in range(6)]
    item = " ".join(rnd.choice(vocab) + "ing" for _ in range(20))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (3, texts[2]), (None, texts[0]), (7, texts[4]), (None, texts[4]), (2, texts[4]), (None, texts[5] + " " + item), (3, item)]
    df = spark.createDataFrame([(k, t, "en", "src", len(t), k, 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, component_id int")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["near_duplicates"](spark, df, str(tmp_path))
    assert kept.columns == df.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text)
    want = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (2, texts[4]), (None, texts[5] + " " + item), (3, item)]
    assert sorted(map(key, kept.collect())) == sorted((k is None, k or 0, t) for k, t in want)
    clean = stage["decontamination"](spark, kept, str(tmp_path))
    assert clean.columns == df.columns and sorted(map(key, clean.collect())) == sorted((k is None, k or 0, t) for k, t in want[:5])


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), name)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
        docs = out
