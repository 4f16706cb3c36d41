"""documents -> language ID -> near-duplicate groups -> decontamination -> PII -> packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages

#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = stages.STAGES

#: SQL cannot express tokenising, edit distance or a trained language model; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; each stage's output is written and read again."""
    return stages.run(spark, sf_dir)
