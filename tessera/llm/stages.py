"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Each works on every row that the stage before kept and, but for the last, returns the columns of
documents, further ones included. Null and empty texts have no language and go in the first stage;
very long ones are taken whole. Null and shared ids are no reason to go. An empty table goes
through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.queries import vocabulary
from tessera.llm.shared import drop, if_small, settled, table, written


LEAST_SCORE = 0.3


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells all rows apart: doc_id itself if no id is null or shared, else
    a number of its own for each row, in a written table, so that it stays what it is."""
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs, "doc_id"
    key = "row_number"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs but for the rows with these keys."""
    return docs.join(if_small(gone), key, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language the model cannot tell go: those without a letter, and those whose
    likeliest language has a posterior of LEAST_SCORE at most (two languages that fit equally well
    have 0.5 each). A null lang becomes the predicted one."""
    from tessera.llm.language import keep_identified, train

    return keep_identified(docs, train(docs, vocabulary("piece_bpe_32k.model"), sample=300), least_score=LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once. Rows without
    an id, or of which several share one, are told apart by their texts like any other; of a group's
    rows with equal ids, or with none but such, one stays."""
    from tessera.llm.ngram_join import ngram_jaccard_join

    docs, key = _keyed(docs)

    def others() -> DataFrame:
        found = ngram_jaccard_join(docs, n=5, percent=80, id_col=key)
        if key == "doc_id":
            return found.where("doc_id <> component_id").select(key)
        found = written(found.join(docs.select(key, F.col("doc_id").alias("of")), key), "groups")
        first = found.groupBy("component_id").agg(F.min(F.struct(F.col("of").isNull(), "of", key)).alias("m")).select(F.col(f"m.{key}").alias(key))
        return found.select(key).join(first, key, "left_anti")

    return _without(docs, key, settled(spark, "dropped", others)).select(*(c for c in docs.columns if c != key or key == "doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each by its own text, whatever its id."""
    from tessera.llm.decontaminate import find_leaks

    docs, key = _keyed(docs)
    gone = settled(spark, "dropped", lambda: find_leaks(docs, table(spark, sf_dir, "benchmark"), max_edit=0.2, id_col=key).select(key).distinct())
    return _without(docs, key, gone).select(*(c for c in docs.columns if c != key or key == "doc_id"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    from tessera.llm.pii import redact_column

    return redact_column(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    from tessera.llm.packing import pack

    return pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), capacity=1024, end_id=2)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("pii", redact_pii), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop(spark, before)
        before = docs.inputFiles()[:1]
    return STAGES[-1][1](spark, docs, sf_dir)
