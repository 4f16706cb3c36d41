"""The numbered queries, each an operator of this package applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversations, filter_audit, substring_dedup
from tessera.llm.licenses import duckdb_sql
from tessera.llm.shared import settled, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op1_license_scan": duckdb_sql(),
    "op11_filter_audit": filter_audit.duckdb_sql(),
    "op12_substring_dedup": substring_dedup.duckdb_sql(),
    "op13_conversation_repair": conversations.duckdb_sql(),
    "op6_ngram_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] WHEN len(words) > 0 THEN [array_to_string(words, ' ') || ' '] ELSE [] END) AS shingle FROM w),
     n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
     r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
     o AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM o""",
}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import language_id

    return language_id(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), sample=300)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_edit=0.2)


@query
def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=5, percent=80)


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"), least=100)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), capacity=1024, end_id=2)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "audit", lambda: filter_audit.audit(filter_audit.failed_filters(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests() -> DataFrame:
        kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
        return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

    return settled(spark, "deduplicated", digests)


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "repair", lambda: conversations.repair_report(table(spark, sf_dir, "conversations")))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return dict(QUERIES) | {"pipeline": corpus_pipeline.run}


def all_oracles() -> dict[str, str]:
    import corpus_pipeline

    return dict(ORACLE) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
