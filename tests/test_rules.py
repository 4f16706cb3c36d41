"""Relation records and files."""

from tessera.operators import rules as R

def test_relation_records(spark):
    raw = [
        (1, {"source_label": " EightDReport", "start_bk": "R", "end_label": "CauseItem", "dst_key": "C", "relationship_type": "direct_cause"}),
        (2, {"from_label": "CauseItem", "from_key": "C", "to_label": "Chunk", "to_key": "K", "rel": "mentioned_in"}),
        (3, {"from_label": "CauseItem", "from_key": "C", "to_label": "EightDReport", "to_key": "R", "rel_type": "ROOT_CAUSE"}),
        (4, {"from_label": "EightDReport", "from_key": "R", "to_label": "CauseItem", "to_key": "", "rel_type": "ROOT_CAUSE"}),
        (5, None),
    ]
    got = {tuple(r) for r in R.relations(spark.createDataFrame(raw, "doc int, fields map<string,string>")).collect()}
    assert got == {(1, "EightDReport", "R", "ROOT_CAUSE", "CauseItem", "C"), (2, "CauseItem", "C", "MENTIONED_IN", "Chunk", "K")}


def test_files_over_the_limit_have_an_error(spark, tmp_path, monkeypatch):
    from tessera.sources import documents as D

    monkeypatch.setattr(D, "MAX_BYTES", 10)
    (tmp_path / "a.docx").write_bytes(b"x" * 11)
    (tmp_path / "b.docx").write_bytes(b"x" * 10)
    got = {r.path[-6:]: r for r in D.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].error and got["a.docx"].content is None and got["b.docx"].error is None and len(got["b.docx"].content) == 10


def test_inference_leaves_reports_where_they_are(spark):
    from tessera.operators import rules as R
    from tessera.plans.rule_queries import _extraction, _tables
    from tessera.plans.tables import grouped

    orders, items = _tables(spark, "/root/testdata/sf0.001")
    plan = R.inferred(_extraction(orders, items)).distinct()._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    kept = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    assert grouped(spark).conf.get("spark.sql.shuffle.partitions") == "8" and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == kept


def test_named_reports_are_dealt_once(spark):
    """Tables that rules read often are kept as they are dealt: no shuffle for what is joined by report."""
    from tessera.operators import enrich as E
    from tessera.operators import keys as K
    from tessera.plans.rule_queries import _named

    x, _ = _named(spark, "/root/testdata/sf0.001")
    x = E.completed(x)
    first = K.synced(x, K.report_keys(x))[1]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "BroadcastHashJoin" not in plan
    second = K.synced(K.synced(x, K.report_keys(x))[0], K.report_keys(x))[1]
    assert second.isEmpty()  # why key_sync and enrich need not see unchanged tables again


def test_native_forms_are_those_of_the_patterns(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    c = F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')")
    rows = spark.range(0xD800).unionByName(spark.range(0xE000, 0x10000)).select(F.concat(c, c, F.lit("Aé"), c, F.lit("b\n"), c).alias("s"))
    was = F.regexp_replace(F.lower("s"), r"(?U)[\s\-_()（）,.，:：;；]+", "")
    stripped = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    assert rows.where(~T.norm(F.col("s")).eqNullSafe(was) | ~T.strip(F.col("s")).eqNullSafe(stripped)).isEmpty()


def test_long_methods_are_left_to_plain_projections(spark):
    from tessera.plans.tables import grouped

    assert grouped(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000", "longer methods are never compiled by the JVM"
