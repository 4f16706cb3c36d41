"""Text functions, upserts, graph invariants and streams on small rows."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.substrings import word_pairs
from tessera.operators import corpus as C
from tessera.operators import query as Q
from tessera.operators import upsert as U
from tessera.operators.graph import PropertyGraph
from tessera.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.tokenize(lit("  Spring，Break; a 断裂 "))) == ["spring", "break", "断裂"]
    assert one(spark, T.tokenize(lit("a"))) == ["a"] and one(spark, T.tokenize(lit("  "))) == []
    assert one(spark, T.norm(lit("A-b_(C)　（d）：e"))) == "abcde"
    assert one(spark, T.strip(lit("　 x \t"))) == "x"
    score = lambda t, *k: one(spark, T.score(lit(t), F.array(*map(lit, k)) if k else F.array().cast("array<string>")))
    assert score("the spring broke", "spring") == 0.95 and score("none", "spring") == 0.35 and score("the spring", "spring", "gone") == 0.65 and score("x") == 0.0
    assert one(spark, T.report_id(lit("see 8d_ab12/3 and"))) == "8D-AB12/3" and one(spark, T.report_id(lit("no id"))) is None
    assert one(spark, T.product_key(lit("valve EP100x"), lit(None).cast("string"))) == "FP-FAMILY::EP100X"
    assert one(spark, T.product_key(lit("Valve"), lit("12-3"))) == "FP-PN::123" and one(spark, T.product_key(lit(""), lit(""))) == "FP-UNKNOWN"
    assert one(spark, T.email_key(lit(" A b@C.de"))) == "PER::ab@c.de" and one(spark, T.email_key(lit("ab"))) is None
    assert one(spark, T.valid_key(lit("unknown-1"))) is None and one(spark, T.valid_key(lit(" FS-1 "))) == "FS-1"
    assert one(spark, T.person_name(lit("王明"))) and not one(spark, T.person_name(lit("Bob")))
    assert one(spark, T.without_think(lit("<think>a\nb</think>\n```json\n{}\n```"))) == "{}"
    assert one(spark, T.format_of(F.unhex(lit("504B030400000000")))) == "docx" and one(spark, T.format_of(F.unhex(lit("00")))) is None
    props = F.create_map(lit("a"), lit(" "), lit("b"), lit("hello world"))
    assert one(spark, T.best_content(props, ["a"])) == "hello world"


def test_upsert_is_idempotent_and_keeps_what_new_lacks(spark):
    old = spark.createDataFrame([(1, "a", "x", "t0"), (2, "b", None, "t0")], "k int, name string, note string, created_at string")
    new = spark.createDataFrame([(2, None, "n", "t1"), (3, "c", None, "t1")], "k int, name string, note string, created_at string")
    once = U.upsert(old, new, ["k"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", "x", "t0"), (2, "b", "n", "t0"), (3, "c", None, "t1")}
    assert {tuple(r) for r in U.upsert(once, new, ["k"]).collect()} == {tuple(r) for r in once.collect()}


def test_keep_first_and_status(spark):
    a = spark.createDataFrame([(1, "explicit")], "k int, v string")
    b = spark.createDataFrame([(1, "inferred"), (2, "inferred")], "k int, v string")
    assert {tuple(r) for r in U.keep_first([a, b], ["k"]).collect()} == {(1, "explicit"), (2, "inferred")}
    runs = spark.createDataFrame([(1, "pending"), (2, "failed"), (3, "success")], "id int, status string").withColumn("cancelled", F.lit(False))
    assert {(r.id, r.status, r.accepted) for r in U.next_status(runs, "cancel").collect()} == {(1, "failed", True), (2, "failed", False), (3, "success", False)}
    assert {(r.id, r.accepted, r.new_run) for r in U.next_status(runs, "retry").collect()} == {(1, True, False), (2, True, True), (3, False, False)}


def small_graph(spark):
    n = [("A", k) for k in "abcd"] + [("Chunk", "x"), ("B", "a")]
    e = [("A", "a", "T", "A", "b"), ("A", "a", "U", "A", "b"), ("A", "b", "T", "Chunk", "x"), ("Chunk", "x", "T", "A", "c"), ("A", "a", "T", "A", "a")]
    nodes = spark.createDataFrame([(*x, "t") for x in n], "label string, business_key string, title string").withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    edges = spark.createDataFrame(e, "from_label string, from_key string, rel_type string, to_label string, to_key string").withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return PropertyGraph(nodes, edges)


def test_neighbourhood(spark):
    g = small_graph(spark)
    keys = lambda df: {(r.label, r.business_key) for r in df.collect()}
    assert keys(g.neighbourhood("A", "a", 0)) == {("A", "a")} and g.neighbourhood("A", "none", 2).count() == 0
    nodes, edges = g.subgraph("A", "a", 3, exclude=("Chunk",))
    assert keys(nodes) == {("A", "a"), ("A", "b"), ("A", "c")}, "what is reached through an excluded node stays"
    assert edges.count() == 3
    assert g.subgraph("A", "a", 0)[1].count() == 1
    there = {r.business_key for r in g.neighbourhood("A", "a", 2).collect()}
    assert "x" in there and "a" in {r.business_key for r in g.neighbourhood("Chunk", "x", 2).collect()}
    assert [(r.business_key, r.degree) for r in g.centres("A", 2).collect()] == [("a", 3), ("b", 3)]
    assert {(r.direction, r.business_key) for r in g.incident("A", "b").collect()} == {("in", "a"), ("out", "x")}


def test_corpus_operators(spark):
    t = spark.createDataFrame([(1, "One line\n  One   line \n!!!!\nx\nTwo words here"), (2, "")], "id int, text string")
    assert {tuple(r) for r in C.salvage_lines(t).collect()} == {(1, "One line\nTwo words here"), (2, "")}
    tables = spark.createDataFrame([(1, ["Name", "E-mail"]), (2, ["x"]), (3, ["part no", "qty", "name"])], "id int, headers array<string>")
    kinds = {r.id: r.table_type for r in C.classify_tables(tables, {"team": ["name", "mail"], "parts": ["part", "qty"], "named": ["name"]}).collect()}
    assert kinds == {1: "team", 2: "unknown", 3: "parts"}
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "quick"), (3, "a quick, brown fox")], "id int, text string")
    alias = spark.createDataFrame([(7, "Quick brown FOX"), (8, "quick"), (9, None)], "pattern_id int, text string")
    assert {tuple(r) for r in word_pairs(texts, alias).collect()} == {(1, 7), (3, 7), (1, 8), (2, 8), (3, 8)}


def test_search(spark):
    df = spark.createDataFrame([("1", "a 10% rise", 1), ("2", "a 10x rise", 2), ("3", "none", 3)], "id string, text string, at int")
    got = Q.search_chunks(df, "10%", 5)
    assert [r.id for r in got.collect()] == ["1", "2"], "wildcards hold, best first"
    assert [r.id for r in Q.search_chunks(df, "rise", 1).collect()] == ["2"], "of equals the newest"
    both = Q.merged(got.limit(0), got.unionByName(got.withColumn("score", F.lit(0.1))), 100)
    assert both.count() == 2


def test_streams(spark, tmp_path):
    day = "2024-01-0{} 00:00:0{}"
    rows = [(day.format(1, 1), "x"), (day.format(1, 2), "x"), (day.format(2, 1), "y")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "received_at string, text string").selectExpr("CAST(received_at AS timestamp) AS received_at", "text").write.parquet(src)
    stream = spark.readStream.schema("received_at timestamp, text string").parquet(src)
    out = str(tmp_path / "out")
    E.new_documents(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format("parquet").start(out).awaitTermination()
    assert {r.text for r in spark.read.parquet(out).collect()} == {"x", "y"} and spark.read.parquet(out).count() == 2
    versions = str(tmp_path / "v")
    merge = E.upsert_into(versions, ["k"])
    merge(spark.createDataFrame([(1, "a")], "k int, v string"), 0)
    merge(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), 1)
    merge(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), 1)
    assert {tuple(r) for r in spark.read.parquet(f"{versions}/v=1").collect()} == {(1, "b"), (2, "c")}


def test_unknown_chunks_give_way(spark):
    from tessera.operators import chunks as K

    text = "a text that is long enough to meet"
    chunks = spark.createDataFrame([("UNKNOWN#1", "UNKNOWN", text), ("FS-1#1", "FS-1", text + " and more"), ("UNKNOWN#2", "UNKNOWN", "something else entirely here")], "chunk_id string, report_id string, text string")
    mentions = spark.createDataFrame([("A", "UNKNOWN#1"), ("A", "FS-1#1"), ("B", "UNKNOWN#2")], "from_key string, to_key string")
    m, c = K.reconciled(mentions, chunks)
    assert {tuple(r) for r in m.collect()} == {("A", "FS-1#1"), ("B", "UNKNOWN#2")} and {r.chunk_id for r in c.collect()} == {"FS-1#1", "UNKNOWN#2"}


def test_stages_are_recorded(spark, tmp_path):
    import pytest

    from tessera.operators.stages import run_stages

    def write(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def broken(df):
        raise ValueError("no")

    out, metrics = run_stages(spark.range(10), [("odd", lambda d: d.where("id % 2 = 1")), ("broken", broken), ("more", lambda d: d.where("id > 3"))], write, fail_fast=False)
    assert out.count() == 3 and [m["rows"] for m in metrics] == [5, None, 3] and "ValueError" in metrics[1]["error"]
    with pytest.raises(RuntimeError):
        run_stages(spark.range(1), [("broken", broken)], write)


def test_prefix_pairs_of_short_and_empty_texts(spark):
    texts = ["A.", "A.", "A. long enough to have a head", "A. long enough to have", "é", "éa", "", "", "0123456789abcde", "0123456789abcdef", "B", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, j) for i, s in enumerate(texts) for j, g in enumerate(texts) if i != j and s is not None and g is not None and g.startswith(s) and (s or not g))
    assert sorted(tuple(r) for r in C.prefix_pairs(df, df).collect()) == want


def test_reconciled_chunks_of_short_texts(spark):
    from tessera.operators import chunks as K

    rows = [("U#1", "UNKNOWN", "short"), ("R#1", "R", "short text that goes on and on"), ("U#2", "UNKNOWN", "tiny and then much longer"), ("R#2", "R", "tiny"), ("U#3", "UNKNOWN", ""), ("U#4", "UNKNOWN", "other")]
    chunks = spark.createDataFrame(rows, "chunk_id string, report_id string, text string")
    mentions = spark.createDataFrame([("a", "U#1"), ("b", "U#2"), ("c", "U#3"), ("d", "U#4")], "from_key string, to_key string")
    m, c = K.reconciled(mentions, chunks)
    assert sorted(tuple(r) for r in m.collect()) == [("a", "R#1"), ("b", "R#2"), ("c", "U#3"), ("d", "U#4")]
    assert sorted(r.chunk_id for r in c.collect()) == ["R#1", "R#2", "U#3", "U#4"]


def test_distinct_texts_of_the_prefix_join_are_made_once(spark):
    from tessera.plans.text_queries import prefix_theta_join

    plan = prefix_theta_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(doc_id" not in plan  # each branch reads the stored texts
