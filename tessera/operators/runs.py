"""Uploads and extraction runs as state changes over whole tables: each returns rows, nothing is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.upsert import upsert

MAX_BYTES = 50 << 20


def uploads(files: DataFrame, documents: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """files(id, content) -> (id, sha256, document_id, outcome): too_large, unsupported, exists or new.
    A file with the content of one of documents(document_id, sha256) exists under its id; of new files
    with equal content the first by id is the document."""
    f = files.select("id", F.octet_length("content").alias("_n"), T.format_of(F.col("content")).alias("_format"), F.sha2("content", 256).alias("sha256"))
    f = f.withColumn("_bad", F.when(F.col("_n") > most, "too_large").when(F.col("_format").isNull(), "unsupported"))
    known = documents.groupBy("sha256").agg(F.min("document_id").alias("_known"))
    first = f.where("_bad IS NULL").groupBy("sha256").agg(F.min("id").alias("_first"))
    met = f.join(first, "sha256", "left").join(known, "sha256", "left")
    document = F.when(F.col("_bad").isNull(), F.coalesce(F.col("_known"), F.col("_first")))
    outcome = F.coalesce("_bad", F.when(F.col("_known").isNotNull() | (F.col("id") != F.col("_first")), "exists").otherwise("new"))
    return met.select("id", "sha256", document.alias("document_id"), outcome.alias("outcome"))


def triggered(requests: DataFrame, documents: DataFrame, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(runs, refused): a pending run for every request(run_id, document_id, at) of a known document."""
    known = documents.select("document_id").distinct()
    runs = requests.join(known, "document_id", "left_semi").select("run_id", "document_id", F.lit("pending").alias("status"), F.col("at").alias("started_at"), F.lit(version).alias("version"))
    return runs, requests.join(known, "document_id", "left_anti").select("run_id", "document_id", F.lit("document not found").alias("error"))


def startable(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """tasks(run_id) -> (run_id, refusal): why a worker must not begin, else null; runs(run_id, status, cancelled)."""
    met = tasks.join(runs.select("run_id", "status", "cancelled", F.lit(True).alias("_known")), "run_id", "left")
    stopped = (F.col("status") == "failed") & F.coalesce("cancelled", F.lit(False))
    return met.select("run_id", F.when(F.col("_known").isNull(), "run not found").when(stopped, "cancelled").alias("refusal"))


def finished(runs: DataFrame, results: DataFrame) -> DataFrame:
    """runs(run_id, status, finished_at, tokens, error) after results(run_id, tokens, error, at): success
    without an error, else failed. Results of unknown runs change nothing."""
    known = results.join(runs.select("run_id"), "run_id", "left_semi")
    new = known.select("run_id", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), F.col("at").alias("finished_at"), "tokens", "error")
    return upsert(runs, new, ["run_id"])


def audit_rows(summaries: DataFrame) -> DataFrame:
    """Rows to append to the audit table, one per summary(run_id, document_id, ...): the other columns
    are the JSON of after_value."""
    rest = [c for c in summaries.columns if c not in ("run_id", "document_id")]
    return summaries.select(
        F.lit("pipeline_completed").alias("action"), F.lit("extraction_run").alias("target_type"), F.col("run_id").cast("string").alias("target_id"),
        F.to_json(F.struct(*rest)).alias("after_value"), F.col("document_id").cast("string").alias("trace_id"),
    )


def stale_unknown(reports: DataFrame, chunk_edges: DataFrame, title: str) -> DataFrame:
    """Reports without a file that have this title, are only called FS-UNKNOWN, and have no chunk."""
    unknown = (F.col("business_key") == "FS-UNKNOWN") | (F.col("report_no") == "FS-UNKNOWN")
    mine = reports.where(F.col("filename").isNull() & (F.col("issue_title") == title) & unknown)
    return mine.join(chunk_edges.where("rel_type = 'CHUNK_OF_REPORT'").select(F.col("to_key").alias("business_key")), "business_key", "left_anti")
