"""Chunks and what refers to them: edges, ids, evidence texts, summaries and coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.corpus import begins


def mention_edges(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """MENTIONED_IN edges of entities(label, business_key, supporting_chunks) to chunks that exist."""
    pairs = entities.select(F.col("label").alias("from_label"), F.col("business_key").alias("from_key"), F.explode(F.array_distinct("supporting_chunks")).alias("to_key"))
    known = chunks.select(F.col("chunk_id").alias("to_key")).where("to_key <> ''")
    return pairs.join(known, "to_key", "left_semi").select("from_label", "from_key", F.lit("MENTIONED_IN").alias("rel_type"), F.lit("Chunk").alias("to_label"), "to_key")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """CHUNK_OF_REPORT edges of every chunk with an id and a report."""
    ok = chunks.where("chunk_id <> '' AND report_id <> ''")
    return ok.select(F.lit("Chunk").alias("from_label"), F.col("chunk_id").alias("from_key"), F.lit("CHUNK_OF_REPORT").alias("rel_type"), F.lit("EightDReport").alias("to_label"), F.col("report_id").alias("to_key"))


def rewritten_id(report: Column, chunk_id: Column, place: Column) -> Column:
    """{report}# and what follows the first # of the id, else full_document#{place}."""
    tail = F.regexp_extract(chunk_id, "^[^#]*#(.+)$", 1)
    return F.concat(report, F.lit("#"), F.coalesce(F.nullif(tail, F.lit("")), F.concat(F.lit("full_document#"), place.cast("string"))))


def reconciled(mentions: DataFrame, chunks: DataFrame, width: int = 16) -> tuple[DataFrame, DataFrame]:
    """(mentions, chunks) after chunks of unknown reports gave way: one whose text begins a known
    chunk's text, or the other way round, is dropped and its mentions move to that chunk (the first by
    id). Texts meet as in corpus.begins()."""
    bad = chunks.where("report_id = 'UNKNOWN'").select(F.col("chunk_id").alias("id"), "text")
    good = chunks.where("report_id <> 'UNKNOWN'").select(F.col("chunk_id").alias("id"), "text")
    met = begins(bad, good, width).toDF("bad", "good").unionByName(begins(good, bad, width).toDF("good", "bad"))
    moved = met.groupBy("bad").agg(F.min("good").alias("good"))
    to = moved.withColumnRenamed("bad", "to_key")
    kept = mentions.join(to, "to_key", "left").withColumn("to_key", F.coalesce("good", "to_key")).select(mentions.columns).distinct()
    return kept, chunks.join(moved.select(F.col("bad").alias("chunk_id")), "chunk_id", "left_anti")


def supporting_text(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(business_key, evidence): the texts of an entity's chunks in the order of its references."""
    refs = entities.select("business_key", F.posexplode("supporting_chunks").alias("pos", "chunk_id"))
    met = refs.join(chunks.select("chunk_id", "text"), "chunk_id")
    return met.groupBy("business_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias("evidence"))


def display_name(names: list[Column], key: Column) -> Column:
    """The first non-blank name, 14 characters and an ellipsis; else the key, 16 characters."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    name = F.coalesce(*(F.nullif(T.strip(c), F.lit("")) for c in names))
    return F.coalesce(cut(name, 14), cut(key, 16))


def summary(*columns: str) -> Column:
    """A record's fields as JSON, without those that are null."""
    return F.to_json(F.struct(*columns))


def coerced(props: Column) -> Column:
    """A string map by field name: confidence, *_score and *_probability as numbers, is_* as true or
    false; null values and values that do not fit go."""
    number = lambda k: (k == "confidence") | k.endswith("_score") | k.endswith("_probability")

    def value(k: Column, v: Column) -> Column:
        flag = F.when(F.lower(v).isin("true", "1", "yes"), "true").when(F.lower(v).isin("false", "0", "no"), "false")
        return F.when(number(k), v.try_cast("double").cast("string")).when(k.startswith("is_"), flag).otherwise(v)

    return F.map_filter(F.transform_values(props, value), lambda _, v: v.isNotNull())
