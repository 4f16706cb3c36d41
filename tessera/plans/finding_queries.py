"""Findings with their polarity, and records extracted from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import extraction as X
from tessera.operators import findings as N
from tessera.plans.catalog import query
from tessera.plans.tables import load, python_path

TERMS = ["license", "copyright", "warranty", "token", "thing", "being"]
CUES = N.Cues(negative=("no", "not", "without", "in", "of"), behind=("by",), doubt=("may", "that"), ends=("but", "however", "and"))


@query()
def finding_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every document as present, in doubt or denied, with common words of the invented prose as cues."""
    return N.findings(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), TERMS, CUES).withColumnRenamed("id", "doc_id")


FIELDS = {"mail": r"[a-z0-9.]+@[a-z0-9.]+[a-z0-9]", "phone": r"\+([0-9][0-9 -]+[0-9])"}


@query(f"""WITH d AS (SELECT doc_id AS id, regexp_extract(text, '{FIELDS["mail"]}') AS mail, regexp_extract(text, '{FIELDS["phone"].replace("+", "+", 1)}', 1) AS phone, regexp_extract(text, '[A-Za-z]+') AS word FROM documents)
SELECT id, CASE WHEN mail <> '' OR phone <> '' THEN 'contacts' WHEN word <> '' THEN 'words' END AS extractor, nullif(mail, '') AS mail, nullif(phone, '') AS phone, CASE WHEN mail = '' AND phone = '' THEN nullif(word, '') END AS word,
 CASE WHEN mail <> '' OR phone <> '' THEN 1 ELSE 2 END AS attempts FROM d""")
def extracted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts where a document has them, else its first word."""
    python_path(spark)
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = X.extracted(texts, [X.PatternExtractor("contacts", FIELDS), X.PatternExtractor("words", {"word": "[A-Za-z]+"})])
    record = F.from_json("payload", "mail string, phone string, word string")
    return found.withColumn("r", record).select("id", "extractor", "r.mail", "r.phone", "r.word", "attempts")
