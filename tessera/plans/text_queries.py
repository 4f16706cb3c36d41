"""Queries over texts: search, normalisers, clean-up, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus as C
from tessera.operators import query as Q
from tessera.operators.substrings import substring_pairs, word_pairs
from tessera.plans.catalog import query
from tessera.plans.tables import load, python_path, stored
from tessera.sources.projection import duckdb_graph, graph

WORDS = {"D2": ["license", "under"], "D4": ["token", "root cause", "@"], "D5": ["555-", "action"]}


def _score_sql(text: str, tokens: list[str]) -> str:
    hits = " + ".join(f"contains(lower({text}), '{t}')::INT" for t in tokens)
    base = f"({hits}) / {len(tokens)}"
    return f"round(least(0.98, 0.35 + 0.6 * (CASE WHEN contains(lower({text}), '{' '.join(tokens)}') THEN least(1.0, {base} + 0.25) ELSE {base} END)), 3)::DOUBLE"


_CHUNKS = f"SELECT 'Chunk' AS type, doc_id::VARCHAR AS id, substr(text, 1, 500) AS content, {_score_sql('substr(text, 1, 500)', ['public', 'license'])} AS score FROM documents WHERE text ILIKE '%public license%' ORDER BY score DESC, n_chars DESC NULLS FIRST, doc_id::VARCHAR LIMIT 30"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("n_chars").alias("at"))
    return Q.search_chunks(d, "public license", 30)


@query(_CHUNKS)
def keyword_search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


_ENTITIES = f"WITH {duckdb_graph()}, h AS (SELECT 'Customer' AS type, 'C' || c_custkey AS id, c_name AS content FROM customer WHERE contains(lower(c_name), '12') OR contains(c_nationkey::VARCHAR, '12') OR contains(c_acctbal::VARCHAR, '12') OR contains(lower(c_mktsegment), '12')) SELECT *, {_score_sql('content', ['12'])} AS score FROM h"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search_entities(graph(spark, sf_dir).with_label("Customer"), "12", ["c_name", "p_name"])


@query(_ENTITIES)
def keyword_search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)


@query(f"WITH c AS ({_CHUNKS}), e AS ({_ENTITIES}) SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM c) ORDER BY score DESC, type, id LIMIT 40")
def search_merged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.merged(_entities(spark, sf_dir), _chunks(spark, sf_dir), 40)


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS uploads FROM documents GROUP BY 1")
def sha256_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("uploads"))


@query("WITH r AS (SELECT doc_id, 'see fs_' || source || '-' || doc_id || ' for ' || text AS t FROM documents) SELECT doc_id, nullif(upper(replace(regexp_extract(substr(t, 1, 2000), '(?i)(?:FS|8D|RPT)[-_]?[A-Z0-9][A-Z0-9\\-_/]{3,}', 0), '_', '-')), '') AS report_id FROM r")
def report_id_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("see fs_"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(" for "), "text")
    return load(spark, sf_dir, "documents").select("doc_id", T.report_id(t).alias("report_id"))


@query("SELECT p_partkey, try_cast(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(pcs?|件|个)?', 1, 'i'), '') AS DOUBLE) AS value, nullif(lower(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(pcs?|件|个)?', 2, 'i')), '') AS unit FROM (SELECT p_partkey, CASE WHEN p_size < 15 THEN p_size || ' PCS' WHEN p_size < 30 THEN 'x' || p_size || '.5件' ELSE 'none' END AS t FROM part)")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_size") < 15, F.concat(size, F.lit(" PCS"))).when(F.col("p_size") < 30, F.concat(F.lit("x"), size, F.lit(".5件"))).otherwise("none")
    p = load(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    return p.select("p_partkey", T.amount_value(F.col("t")).alias("value"), T.amount_unit(F.col("t")).alias("unit"))


@query("SELECT regexp_replace(lower(p_type || ' (' || p_brand || ')'), '[\\s\\-_()（）,，.:：;；]+', '', 'g') AS norm, count(*) AS parts FROM part GROUP BY 1")
def norm_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(T.norm(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).alias("norm")).agg(F.count(F.lit(1)).alias("parts"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '[\\r\\n\\x0B\\x0C\\x07\\t]+')) AS line, generate_subscripts(string_split_regex(text, '[\\r\\n\\x0B\\x0C\\x07\\t]+'), 1) AS pos FROM documents),
s AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l),
g AS (SELECT doc_id, line, min(pos) AS pos FROM s WHERE length(line) BETWEEN 2 AND 300 AND length(regexp_replace(line, '[^A-Za-z0-9\\x{4e00}-\\x{9fff}]', '', 'g')) >= greatest(1, 0.35 * length(line)) AND NOT regexp_matches(line, '^[-_=*·. ]*$|(?i:^(?:DOCPROPERTY|MERGEFORMAT|HYPERLINK|PAGEREF)\\b)|(?i:^Toc\\d+$)') GROUP BY doc_id, line),
r AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS salvaged FROM r WHERE before < 220000 GROUP BY doc_id)
SELECT d.doc_id AS id, coalesce(salvaged, '') AS salvaged FROM documents d LEFT JOIN j USING (doc_id)""")
def lines_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.salvage_lines(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query("SELECT doc_id AS id, array_to_string(list_filter(['base', 'report', " + ", ".join(f"CASE WHEN {_any(w)} THEN '{m}' END" for m, w in WORDS.items()) + "], lambda x: x IS NOT NULL), ',') AS modules FROM documents")
def multi_label_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.route(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), WORDS, ["base", "report"])


@query("""WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS line FROM documents), b AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS body FROM benchmark)
SELECT doc_id AS id, item_id AS alias_id FROM w JOIN b ON contains(line, body)""")
def alias_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pairs(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), "text")).withColumnRenamed("pattern_id", "alias_id")


_NORM = "regexp_replace(lower({}), '[\\s\\-_()（）,.，:：;；]+', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id AS id, {_NORM.format("text")} AS line FROM documents), b AS (SELECT item_id AS pattern_id, {_NORM.format("substring(text, 4, 17)")} AS body FROM benchmark)
SELECT id, pattern_id FROM d JOIN b ON length(body) >= 3 AND contains(line, body)""")
def substring_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of benchmark texts that begin and end within words, wherever the normal form of a document holds them."""
    patterns = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.substring("text", 4, 17).alias("text"))
    return substring_pairs(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), patterns)


@query("""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, substr(text, 1, 5 + doc_id % 40) FROM documents WHERE doc_id % 10 = 0), g AS (SELECT min(doc_id) AS id, text FROM d GROUP BY text)
SELECT s.id AS short_id, g.id AS long_id FROM g s JOIN g ON starts_with(g.text, s.text) AND s.id <> g.id AND s.text <> ''""")
def prefix_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and the beginnings of every tenth."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    heads = d.where("doc_id % 10 = 0").select(F.col("doc_id") + 1_000_000_000, F.expr("substring(text, 1, CAST(5 + doc_id % 40 AS INT))"))
    once = stored(d.union(heads).groupBy("text").agg(F.min("doc_id").alias("id")))  # read five times
    return C.prefix_pairs(once, once)


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id")
def ordered_text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("role", F.lit(": "), "text")
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("a"), F.array_sort(F.collect_set("role")).alias("r"))
    return c.select("conv_id", "turns", F.array_join(F.transform("a", lambda s: s["line"]), "\n").alias("body"), F.array_join("r", ",").alias("roles"))


@query("SELECT page_id, host, depth, query_keys FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, length(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]', '', 'g')) AS depth, contains(url, '?') AS query_keys FROM pages)")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.length(F.regexp_replace(path, "[^/]", "")).cast("bigint").alias("depth"), F.col("url").contains("?").alias("query_keys"))


@query("""SELECT doc_id AS id, 'DOC-' || doc_id || '#full_document#0' AS chunk_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::BIGINT AS char_count FROM documents WHERE nullif(regexp_extract(substr(text, 1, 2000), '(?i)(?:FS|8D|RPT)[-_]?[A-Z0-9][A-Z0-9\\-_/]{3,}', 0), '') IS NULL""")
def single_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.single_chunks(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return c.where(F.col("report_id").startswith("DOC-")).select("id", "chunk_id", F.col("char_count").cast("bigint").alias("char_count"))


@query("""WITH t AS (SELECT doc_id AS doc, source, coalesce(text, '') AS text, CASE doc_id % 4 WHEN 0 THEN ['D5 '] WHEN 1 THEN ['x', '根因 tree'] WHEN 2 THEN ['full_document'] ELSE ['other'] END AS path, CASE WHEN doc_id % 7 = 0 THEN 'action' WHEN doc_id % 5 = 0 THEN 'evidence' END AS role FROM documents),
w AS (SELECT doc % 50 AS doc, doc % 4 = 0 OR role = 'action' OR ((doc % 4 = 2 OR role = 'evidence') AND text ILIKE '%license%') AS d5, doc % 4 = 1 OR ((doc % 4 = 2 OR role = 'evidence') AND text ILIKE '%token%') AS d4 FROM t)
SELECT doc, 'base' || CASE WHEN bool_or(coalesce(d4, false)) THEN ',D4' ELSE '' END || CASE WHEN bool_or(coalesce(d5, false)) THEN ',D5' ELSE '' END AS modules FROM w GROUP BY doc""")
def report_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that the chunks of fifty reports ask for, by role, section or text."""
    d = load(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("D5 "))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("x"), F.lit("根因 tree"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("full_document"))).otherwise(F.array(F.lit("other")))
    role = F.when(F.col("doc_id") % 7 == 0, "action").when(F.col("doc_id") % 5 == 0, "evidence")
    chunks = d.select((F.col("doc_id") % 50).alias("doc"), path.alias("section_path"), role.alias("chunk_role"), "text")
    asked = {"D4": (None, ["D4"], ["根因"], ["token"]), "D5": ("action", ["D5"], ["措施"], ["license"])}
    return C.report_modules(chunks, ["base"], asked).select("doc", F.array_join("modules", ",").alias("modules"))


@query("""SELECT doc_id AS id, trim(substr(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), 1, 200)) AS salvaged FROM documents WHERE length(trim(substr(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), 1, 200))) > 1""")
def salvaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of every text as the bytes of a legacy file, with noise round it and half a character behind: it comes
    out alone."""
    python_path(spark)
    line = F.substring(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), 1, 200)
    content = F.concat(F.encode(F.concat(F.lit("-- ==\r\x13 HYPERLINK x\x07Toc12\r"), line, F.lit("\r...\x01\x0b"), line), "UTF-16LE"), F.unhex(F.lit("00D8")))
    return C.salvage_files(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content.alias("content"))).where("salvaged <> ''")
