"""Chunk, evidence and summary operators on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunks as K
from tessera.plans.catalog import query
from tessera.plans.tables import load


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as entities whose supporting chunks are their turns."""
    c = load(spark, sf_dir, "conversations")
    cid = F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"))
    entities = c.groupBy(F.col("conv_id").cast("string").alias("business_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", cid.alias("id")))), lambda s: s["id"]).alias("supporting_chunks")).withColumn("label", F.lit("Conversation"))
    return entities, c.select(cid.alias("chunk_id"), F.col("conv_id").cast("string").alias("report_id"), "role", "text")


@query("SELECT conv_id::VARCHAR AS from_key, 'MENTIONED_IN' AS rel_type, conv_id || '#' || turn AS to_key FROM conversations WHERE role = 'user'")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, chunks = _turns(spark, sf_dir)
    return K.mention_edges(entities, chunks.where("role = 'user'")).select("from_key", "rel_type", "to_key")


@query("SELECT conv_id || '#' || turn AS from_key, conv_id::VARCHAR AS to_key FROM conversations")
def chunk_of_report_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_edges(_turns(spark, sf_dir)[1]).select("from_key", "to_key")


@query("SELECT conv_id::VARCHAR AS business_key, string_agg(text, chr(10) ORDER BY turn) AS evidence FROM conversations GROUP BY 1")
def supporting_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.supporting_text(*_turns(spark, sf_dir))


@query("SELECT 'R' || conv_id || '#' || turn AS chunk_id, count(*) AS n FROM conversations GROUP BY 1")
def chunk_ids_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turns(spark, sf_dir)[1]
    return chunks.groupBy(K.rewritten_id(F.concat(F.lit("R"), "report_id"), F.col("chunk_id"), F.lit(0)).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN length(p_type) > 14 THEN substr(p_type, 1, 14) || '…' ELSE p_type END AS shown FROM part")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", K.display_name([F.lit(" "), F.col("p_type")], F.col("p_partkey").cast("string")).alias("shown"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN '{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}' ELSE '{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\",\"quality\":' || quality || '}' END AS summary FROM documents LEFT JOIN labels USING (doc_id)")
def record_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", K.summary("doc_id", "source", "quality").alias("summary"))


@query("SELECT event_id, value AS confidence, CASE event_type WHEN 'error' THEN 'true' WHEN 'click' THEN 'false' END AS is_failure FROM events")
def coerced_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_type") == "error", "YES").when(F.col("event_type") == "click", "0").otherwise("maybe")
    props = K.coerced(F.create_map(F.lit("confidence"), F.col("value").cast("string"), F.lit("is_failure"), flag))
    return load(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.lit("confidence")).cast("double").alias("confidence"), F.try_element_at(props, F.lit("is_failure")).alias("is_failure"))
