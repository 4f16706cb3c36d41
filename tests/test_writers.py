"""Writers, runs and summaries on small tables: the cases that the registered queries do not hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import runs as R
from tessera.operators import upsert as U
from tessera.plans import catalog


def test_file_names_and_locations(spark):
    uris = ["local:///a/b/c.docx", "local://x/", "minio://bucket/k/f.doc?v=1", "minio://bucket", "minio://bucket//a/b", "MINIO://b/k", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "id int, uri string")
    got = {r.id: (r.f, r.o.bucket, r.o.key, r.o.error) for r in df.select("id", T.file_name(F.col("uri")).alias("f"), T.object_location(F.col("uri")).alias("o")).collect()}
    assert got == {
        0: ("c.docx", None, None, "scheme"), 1: ("x", None, None, "scheme"), 2: ("f.doc", "bucket", "k/f.doc", None), 3: ("bucket", None, None, "key"),
        4: ("b", "bucket", "a/b", None), 5: ("k", "b", "k", None), 6: (None, None, None, "scheme"), 7: (None, None, None, "scheme"),
    }


def test_merged_duplicates(spark):
    rows = [("k", 0, " ab ", ["x", "", "y"], 0.2, None, 5), ("k", 1, "abc", ["y", "z"], 0.9, 3, None), ("k", 2, "xyz", None, 0.1, 4, 7), ("e", 0, " ", [], 0.0, None, None)]
    df = spark.createDataFrame(rows, "key string, n int, name string, chunks array<string>, confidence double, created_at int, updated_at int")
    got = {r.key: (r.name, r.chunks, r.confidence, r.created_at, r.updated_at) for r in U.merge_duplicates(df, ["key"], ["name"], ["chunks"], "n").collect()}
    assert got == {"k": ("abc", ["x", "y", "z"], 0.9, 3, 7), "e": (None, [], 0.0, None, None)}


def test_hierarchy_with_a_cycle(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "parent int, child int")
    got = {(r.root, r.node, r.level) for r in G.descendants(links, spark.createDataFrame([(1,), (9,)], "root int")).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 1), (9, 9, 0)}
    with pytest.raises(ValueError):
        G.descendants(links.where("parent < 3"), spark.createDataFrame([(1,)], "root int"), most=1)


def test_times_and_payloads(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02",), ("2024-02-03T04:05",), ("soon",), (None,)], "raw string")
    got = [(r.p, str(r.v)) for r in df.select(T.time_precision(F.col("raw")).alias("p"), T.time_value(F.col("raw")).alias("v")).collect()]
    assert got == [("day", "None"), ("month", "None"), ("minute", "2024-02-03 04:05:00"), (None, "None"), (None, "None")]


def test_uploads_of_one_batch(spark):
    head = bytes.fromhex("504B0304")
    files = spark.createDataFrame([(1, head + b"a"), (2, head + b"a"), (3, head + b"known"), (4, b"text"), (5, head + b"x" * 20)], "id int, content binary")
    known = files.where("id = 3").select(F.lit(99).alias("document_id"), F.sha2("content", 256).alias("sha256"))
    got = {r.id: (r.document_id, r.outcome) for r in R.uploads(files, known, 12).collect()}
    assert got == {1: (1, "new"), 2: (1, "exists"), 3: (99, "exists"), 4: (None, "unsupported"), 5: (None, "too_large")}


def test_large_frontiers_are_joined(spark, monkeypatch):
    nodes = spark.createDataFrame([("A", str(i), "t") for i in range(6)], "label string, business_key string, title string")
    edges = spark.createDataFrame([("A", str(i), "R", "A", str(i + 1)) for i in range(5)], "from_label string, from_key string, rel_type string, to_label string, to_key string")
    want = {(str(i), i) for i in range(4)}
    for most in (50_000, 0):
        monkeypatch.setattr(G, "FRONTIER", most)
        assert {(r.business_key, r.distance) for r in G.PropertyGraph(nodes, edges).neighbourhood("A", "0", 3).collect()} == want
    with pytest.raises(ValueError):
        G.PropertyGraph(nodes, edges).without_around(nodes)


def _shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_dangling_edges_shuffle_the_same_few_bytes_at_every_size(spark):
    """A broadcast that ends at some size makes what is shuffled jump there; pairs of numbers take few bytes."""
    usual, took = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    try:
        for most in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            before = _shuffled(spark)
            catalog.QUERIES["dangling_edges"](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
            took.append(_shuffled(spark) - before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert took[1] < 1.1 * took[0]
    assert took[1] < 45 * spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()


@pytest.mark.parametrize("few, part", [(1000, 1_000_000), (0, 500)])
def test_dangling_edges_of_tables_with_gaps(spark, tmp_path, monkeypatch, few, part):
    """Orders and parts that are not there, sizes and keys that are null, rows that come twice."""
    monkeypatch.setattr(U, "FEW", few)
    monkeypatch.setattr(U, "PART_EDGES", part)
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    change = {
        "part": "SELECT * REPLACE (CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size) FROM t WHERE p_partkey % 11 <> 3",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS o_custkey) FROM t WHERE o_orderkey % 13 <> 5",
        "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_partkey END AS l_partkey) FROM t UNION ALL SELECT * FROM t WHERE l_orderkey % 5 = 0",
        "supplier": "SELECT * FROM t WHERE s_suppkey <> 4",
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{sf}/{name}.parquet') {change.get(name, 'SELECT * FROM t')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    columns = ["from_key", "rel_type", "to_key", "missing_from", "missing_to"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE['dangling_edges']})").fetchall()
    got = catalog.QUERIES["dangling_edges"](spark, str(tmp_path)).select(columns).collect()
    assert {(r[-2], r[-1]) for r in want} == {(True, False), (False, True), (True, True)}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("few", [1000, 0])
def test_dangling(spark, monkeypatch, few):
    monkeypatch.setattr(U, "FEW", few)
    nodes = spark.createDataFrame([("A", "1"), ("A", "1"), ("B", "2"), ("A", None)], "label string, business_key string")
    edges = spark.createDataFrame([("A", "1", "R", "B", "2"), ("A", "1", "R", "A", "2"), ("B", "1", "R", "B", "2"), ("A", None, "R", "B", None), ("A", "1", "R", "A", "2")], "from_label string, from_key string, rel_type string, to_label string, to_key string")
    got = sorted(((r.from_label, r.from_key, r.to_label, r.to_key, r.missing_from, r.missing_to) for r in U.dangling(edges, nodes).collect()), key=str)
    assert got == [("A", "1", "A", "2", False, True), ("A", "1", "A", "2", False, True), ("A", None, "B", None, True, True), ("B", "1", "B", "2", True, False)]
