import json

import pytest
from pyspark.sql import functions as F
from test_documents import docx

from tessera.operators import corpus as C
from tessera.operators import query as Q
from tessera.operators import rules as R
from tessera.operators import upsert as U
from tessera.sources import documents as D
from tessera.sources import lexicon as L


def test_uris_and_readers(spark, tmp_path):
    assert D.located("local:///a/b.doc", "") == "/a/b.doc" and D.located("minio://bucket/x/y.docx", "s3a://store/") == "s3a://store/bucket/x/y.docx"
    for bad in ("http://x/y", "minio://bucket", "minio:///key", "minio://bucket/", "local://", "x"):
        with pytest.raises(ValueError):
            D.located(bad, "s")
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "a.docx").write_bytes(docx([("Body",), [["K", "K", "N"], ["1", "2", "3", "4"], ["5"]]]))
    (tmp_path / "b.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + "\x07DOCPROPERTY x\rA line of text\r====\r一二三\rA line of text\r#$%^&*()!!\rx\r".encode("utf-16-le") + b"\x00")
    (tmp_path / "c.txt").write_bytes(b"text")
    got = {r.path.rsplit("/", 1)[1]: r for r in D.read_documents(spark, ["minio://bucket/a.docx", f"local://{tmp_path}/b.doc", f"local://{tmp_path}/c.txt"], str(tmp_path)).collect()}
    assert got["a.docx"].text == "Body" and got["a.docx"].reader == "docx" and got["c.txt"].error == "not a Word file"
    assert got["b.doc"].reader == "legacy_text" and got["b.doc"].text.split("\n")[-2:] == ["A line of text", "一二三"] and got["b.doc"].tables is None
    table = D.read_documents(spark, ["minio://bucket/a.docx"], str(tmp_path)).select(D.records(F.get("tables", F.lit(0))).alias("r")).first().r
    assert table == [{"K": "2", "N": "3"}, {"K": "5"}]


def test_lexicon_files(spark, tmp_path):
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps({"organization_aliases": [{"canonical_code": "A", "canonical_name": "Alpha", "org_type": "公司", "aliases": ["a1", "a2"]}, {"canonical_code": "B", "canonical_name": "Beta"}], "table_patterns": {"team": {"required_headers": ["name", "mail"]}, "parts": ["part"]}}))
    assert [tuple(r) for r in L.organization_aliases(spark, str(path)).collect()] == [(0, "A", "Alpha", "a1", "公司"), (0, "A", "Alpha", "a2", "公司"), (1, "B", "Beta", "Beta", None)]
    assert L.table_patterns(str(path)) == {"team": ["name", "mail"], "parts": ["part"]}
    path.write_text("{}")
    assert L.table_patterns(str(path)) != {}
    L.reload()
    assert L.table_patterns(str(path)) == {}


def test_salvaged_lines(spark):
    rows = [(1, "Toc123\nTOC 1\nhyperlink x\nHyperlinks are here\n--==**\na\tb c\x01d\x07e f"), (2, None), (3, "éééé ab"), (4, "x" * 301 + "\n" + "y" * 300)]
    got = dict(map(tuple, C.salvage_lines(spark.createDataFrame(rows, "id int, text string")).collect()))
    assert got == {1: "TOC 1\nHyperlinks are here\nb c d\ne f", 2: "", 3: "", 4: "y" * 300}


def test_modules(spark):
    chunks = spark.createDataFrame([(1, ["全文"], None, "发生故障"), (2, ["other"], None, "发生故障"), (2, ["x", " d4 "], None, ""), (3, None, "action", "原因"), (4, ["y"], "hypothesis", None), (5, ["z"], "evidence", "5why 培训"), (6, ["根因"], None, None)], "doc int, section_path array<string>, chunk_role string, text string")
    got = {r.doc: [m.split("-")[1] for m in r.modules[len(C.BASE_MODULES) :]] for r in C.report_modules(chunks).collect()}
    assert got == {1: ["d2"], 2: ["d4"], 3: ["d4", "d5"], 4: ["d4"], 5: ["d4", "d5"], 6: ["d4"]}


def test_pages_of_runs_and_unknown_names(spark):
    runs = spark.createDataFrame([("a", "d1", 3), ("b", None, None), ("c", "d9", 5), ("e", "d1", 3)], "run_id string, document_id string, started_at int")
    docs = spark.createDataFrame([("d1", "one.docx")], "document_id string, file_name string")
    assert [tuple(r)[0::3] for r in Q.runs_page(runs, docs, 1, 3).collect()] == [("c", None), ("a", "one.docx"), ("e", "one.docx")]
    assert [r.run_id for r in Q.runs_page(runs, docs, 2, 3).collect()] == ["b"]
    R.require(("EightDReport", "Chunk"), ("ROOT_CAUSE",))
    for bad in ({"labels": ("Nobody",)}, {"rel_types": ("ROOT_CAUSE", "KNOWS")}):
        with pytest.raises(ValueError):
            R.require(**bad)


def test_documents_keep_their_ids(spark):
    schema = "document_id string, sha256 string, file_name string, status string, file_size int, updated_at int"
    old = spark.createDataFrame([("d1", "x", "one", "done", 1, 1), ("d2", "y", "two", "done", 2, 1)], schema)
    new = spark.createDataFrame([("n1", "x", "again", "pending", 5, 9), ("n2", "z", "new", "pending", 6, 9), ("n3", "z", "twice", None, 7, 10)], schema)
    kept, ids = U.upsert_documents(old, new)
    assert {tuple(r) for r in kept.select(schema.replace(" string", "").replace(" int", "").split(", ")).collect()} == {("d1", "x", "one", "pending", 5, 9), ("d2", "y", "two", "done", 2, 1), ("n2", "z", "new", None, 7, 10)}
    assert {(r.document_id, r.kept_id) for r in ids.collect()} == {("n1", "d1"), ("n2", "n2"), ("n3", "n2")}
