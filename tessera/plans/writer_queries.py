"""Writers, runs, summaries and hierarchies on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import properties as P
from tessera.operators import query as Q
from tessera.operators import runs as R
from tessera.operators import upsert as U
from tessera.operators.rules import product_rollup as rolled_up
from tessera.plans.catalog import query
from tessera.plans.tables import load
from tessera.sources.projection import duckdb_graph, graph

SQL_GRAPH = "WITH RECURSIVE " + duckdb_graph()


def _key(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string") if isinstance(c, F.Column) else F.col(c).cast("string"))


def _time(t: str | None) -> F.Column:
    return F.lit(t).cast("timestamp_ntz")


@query("""WITH old AS (SELECT 'C' || c_custkey AS f, 'N' || c_nationkey AS t, c_mktsegment AS segment FROM customer),
new AS (SELECT 'C' || (c_custkey + 5) AS f, 'N' || c_nationkey AS t, c_name AS name FROM customer WHERE c_custkey + 5 IN (SELECT c_custkey FROM customer) AND c_nationkey IN (SELECT n_nationkey FROM nation))
SELECT coalesce(o.f, n.f) AS from_key, coalesce(o.t, n.t) AS to_key, segment, name, CASE WHEN o.f IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created_on, CASE WHEN o.f IS NOT NULL AND n.f IS NOT NULL THEN '2024-02-01' END AS updated_on
FROM old o FULL JOIN new n ON o.f = n.f AND o.t = n.t""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    ends = lambda k: (F.lit("Customer").alias("from_label"), _key("C", k).alias("from_key"), F.lit("IN_NATION").alias("rel_type"), F.lit("Nation").alias("to_label"), _key("N", "c_nationkey").alias("to_key"))
    old = c.select(*ends("c_custkey"), F.create_map(F.lit("segment"), "c_mktsegment").alias("props"), _time("2024-01-01").alias("created_at"), _time(None).alias("updated_at"))
    new = c.select(*ends(F.col("c_custkey") + 5), F.create_map(F.lit("name"), "c_name").alias("props"), _time("2024-02-01").alias("at"))
    nodes = c.select(F.lit("Customer").alias("label"), _key("C", "c_custkey").alias("business_key")).unionByName(load(spark, sf_dir, "nation").select(F.lit("Nation").alias("label"), _key("N", "n_nationkey").alias("business_key")))
    prop, day = lambda k: F.try_element_at("props", F.lit(k)).alias(k), lambda x: F.date_format(x, "yyyy-MM-dd")
    return U.merge_edges(old, new, nodes).select("from_key", "to_key", prop("segment"), prop("name"), day("created_at").alias("created_on"), day("updated_at").alias("updated_on"))


@query("""SELECT o_orderkey, 'at=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ';detail={"priority":"' || o_orderpriority || '","customer":' || o_custkey || '}' || CASE WHEN o_orderstatus <> 'P' THEN ';status=' || o_orderstatus ELSE '' END AS props FROM orders""")
def node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.lit("x").alias("node_id"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderdate").alias("at"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer")).alias("detail"))
    shown = F.transform(F.array_sort(F.map_entries(P.flattened(o, ("node_id", "o_orderkey")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return o.select("o_orderkey", F.array_join(shown, ";").alias("props"))


@query("SELECT 'D' || doc_id AS chunk_id, substr(coalesce(text, ''), 1, 500) AS text, 0 AS sections, nullif(lang, '') AS chunk_role FROM documents")
def chunk_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(_key("D", "doc_id").alias("chunk_id"), F.col("source").alias("report_id"), F.lit(None).cast("array<string>").alias("section_path"), F.lit(0).alias("para_idx"), "text", F.col("n_chars").alias("token_count"), F.col("lang").alias("chunk_role"))
    return P.chunk_properties(d).select("chunk_id", "text", F.size("section_path").alias("sections"), "chunk_role")


@query("""WITH p AS (SELECT page_id, 'data/' || substr(url, 8) AS here, url, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT page_id, nullif(CASE WHEN page_id % 3 = 0 THEN string_split(regexp_replace(here, '/+$', ''), '/')[-1] WHEN path <> '' THEN string_split(path, '/')[-1] ELSE string_split(regexp_replace(url, '/+$', ''), '/')[-1] END, '') AS file_name FROM p""")
def source_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the addresses stand for local files."""
    uri = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("local://data/"), F.substr("url", F.lit(8)))).otherwise(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", T.file_name(uri).alias("file_name"))


@query("""WITH p AS (SELECT page_id, page_id % 4 AS m, regexp_extract(url, '^https?://([^/?#]*)', 1) AS bucket, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
e AS (SELECT *, CASE WHEN m = 0 THEN 'scheme' WHEN m = 1 THEN 'bucket' WHEN m = 2 OR path IN ('', '/') THEN 'key' END AS error FROM p)
SELECT page_id, CASE WHEN error IS NULL THEN bucket END AS bucket, CASE WHEN error IS NULL THEN ltrim(path, '/') END AS key, error FROM e""")
def object_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of stored objects, three quarters of them torn in one of three ways."""
    rest, m = F.regexp_replace("url", "^https?://", ""), F.col("page_id") % 4
    uri = F.when(m == 0, F.col("url")).when(m == 1, F.concat(F.lit("minio:///"), rest)).when(m == 2, F.lit("minio://bucket/")).otherwise(F.concat(F.lit("minio://"), rest))
    return load(spark, sf_dir, "pages").select("page_id", T.object_location(uri).alias("o")).select("page_id", "o.*")


@query(r"""WITH s AS (SELECT doc_id AS id, sha256(CASE WHEN lang = 'en' THEN '\x50\x4B\x03\x04'::BLOB || encode(text) ELSE encode(text) END) AS sha256,
CASE WHEN strlen(text) + CASE WHEN lang = 'en' THEN 4 ELSE 0 END > 8000 THEN 'too_large' WHEN text IS NULL OR lang IS DISTINCT FROM 'en' THEN 'unsupported' END AS bad FROM documents),
k AS (SELECT sha256, min(-id) AS known FROM s WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1), f AS (SELECT sha256, min(id) AS first FROM s WHERE bad IS NULL GROUP BY 1)
SELECT id, sha256, CASE WHEN bad IS NULL THEN coalesce(known, first) END AS document_id, coalesce(bad, CASE WHEN known IS NOT NULL OR id <> first THEN 'exists' ELSE 'new' END) AS outcome FROM s LEFT JOIN f USING (sha256) LEFT JOIN k USING (sha256)""")
def upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts stand for files of a known format, labelled ones of good quality for known documents."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("lang") == "en", F.unhex(F.lit("504B0304"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "UTF-8")).alias("content"))
    good = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    known = d.join(good, "doc_id", "left_semi").select((-F.col("doc_id")).alias("document_id"), F.sha2("content", 256).alias("sha256"))
    return R.uploads(d.withColumnRenamed("doc_id", "id"), known, 8000)


@query("SELECT 'R' || doc_id AS run_id, 2 * doc_id AS document_id, CASE WHEN 2 * doc_id IN (SELECT doc_id FROM documents) THEN 'pending' ELSE 'document not found' END AS outcome FROM labels")
def trigger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "labels").select(_key("R", "doc_id").alias("run_id"), (2 * F.col("doc_id")).alias("document_id"), _time("2024-01-01").alias("at"))
    runs, refused = R.triggered(requests, load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")))
    return runs.select("run_id", "document_id", F.col("status").alias("outcome")).unionByName(refused.withColumnRenamed("error", "outcome"))


@query("SELECT 2 * t.o_orderkey AS run_id, CASE WHEN r.o_orderkey IS NULL THEN 'run not found' WHEN r.o_orderstatus = 'F' AND r.o_orderpriority = '1-URGENT' THEN 'cancelled' END AS refusal FROM orders t LEFT JOIN orders r ON r.o_orderkey = 2 * t.o_orderkey")
def startable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("pending").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("cancelled"))
    return R.startable(o.select((2 * F.col("o_orderkey")).alias("run_id")), runs)


@query("""WITH n AS (SELECT 2 * o_orderkey AS k, o_custkey AS tokens, CASE WHEN o_orderstatus = 'F' THEN 'bad' END AS error FROM orders)
SELECT o_orderkey AS run_id, CASE WHEN k IS NULL THEN 'running' WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, tokens, error, k IS NOT NULL AS done FROM orders LEFT JOIN n ON k = o_orderkey""")
def finish_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.lit("running").alias("status"), _time(None).alias("finished_at"), F.lit(None).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("error"))
    results = o.select((2 * F.col("o_orderkey")).alias("run_id"), F.col("o_custkey").alias("tokens"), F.when(F.col("o_orderstatus") == "F", "bad").alias("error"), _time("2024-01-02").alias("at"))
    return R.finished(runs, results).select("run_id", "status", "tokens", "error", F.col("finished_at").isNotNull().alias("done"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'pending' ELSE 'success' END AS status, o_orderstatus IN ('F', 'O') AS accepted, o_orderstatus = 'F' AS new_run FROM orders")
def retry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return U.next_status(load(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "F", "failed").when(s == "O", "pending").otherwise("success").alias("status")), "retry")


@query("""SELECT 'pipeline_completed' AS action, 'extraction_run' AS target_type, o_orderkey::VARCHAR AS target_id, '{"status":"' || o_orderstatus || '","nodes":' || length(o_orderpriority) || '}' AS after_value, o_custkey::VARCHAR AS trace_id FROM orders""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit_rows(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"), F.length("o_orderpriority").alias("nodes")))


@query("SELECT event_type AS label, user_id::VARCHAR AS business_key, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.duplicate_keys(load(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("user_id").cast("string").alias("business_key")))


@query(f"""{SQL_GRAPH}, e AS (SELECT from_key, to_key FROM edges WHERE from_label <> 'Part' AND to_label <> 'Part' ORDER BY coalesce(updated_at, created_at) DESC NULLS FIRST, from_label, from_key, rel_type, to_label, to_key LIMIT 600)
SELECT label, business_key, title FROM nodes WHERE business_key IN (SELECT from_key FROM e UNION ALL SELECT to_key FROM e)""")
def global_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).latest_graph(600, ("Part",))[0].select("label", "business_key", "title")


@query(f"""{SQL_GRAPH} SELECT a.rel_type, a.to_key AS business_key, b.to_key AS then_key FROM edges a LEFT JOIN edges b ON b.from_label = a.to_label AND b.from_key = a.to_key AND b.rel_type = 'SUPPLIED_BY' WHERE a.from_label = 'Order' AND a.from_key = 'O7' AND a.rel_type IN ('CONTAINS', 'REPLACES')""")
def report_action_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).listing("Order", "O7", ["CONTAINS", "REPLACES"], "SUPPLIED_BY")


@query(f"""{SQL_GRAPH}, sym AS (SELECT from_label AS l, from_key AS k, to_label AS tl, to_key AS tk FROM edges UNION SELECT to_label, to_key, from_label, from_key FROM edges), d0 AS (SELECT label, business_key FROM nodes WHERE label = 'Region' AND business_key < 'R2'),
d1 AS (SELECT * FROM d0 UNION SELECT tl, tk FROM d0 JOIN sym ON l = label AND k = business_key), d2 AS (SELECT * FROM d1 UNION SELECT tl, tk FROM d1 JOIN sym ON l = label AND k = business_key)
SELECT label, count(*) AS nodes FROM nodes WHERE (label, business_key) NOT IN (SELECT (label, business_key) FROM d2) GROUP BY label""")
def delete_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.without_around(g.with_label("Region").where("business_key < 'R2'"), 2, across=True).node_counts()


@query("SELECT 'D' || doc_id AS business_key FROM documents WHERE n_chars > 300 AND lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_unknown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(_key("D", "doc_id").alias("business_key"), F.lit("FS-UNKNOWN").alias("report_no"), F.when(F.col("n_chars") > 300, F.lit(None).cast("string")).otherwise(F.col("source")).alias("filename"), F.col("lang").alias("issue_title"))
    e = load(spark, sf_dir, "labels").select(F.lit("CHUNK_OF_REPORT").alias("rel_type"), _key("D", "doc_id").alias("to_key"))
    return R.stale_unknown(d.withColumn("filename", F.coalesce("filename", F.lit(None).cast("string"))), e, "en").select("business_key")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_name, p_size, p_retailprice, unnest([p_type, lower(p_type)]) AS v, unnest([0, 1]) AS pos FROM part),
f AS (SELECT p_brand, v, min((p_partkey, pos)) AS place FROM r WHERE v <> '' GROUP BY ALL), l AS (SELECT p_brand, string_agg(v, ',' ORDER BY place) AS chunks FROM f GROUP BY 1)
SELECT p_brand, arg_max(p_name, (length(p_name), -p_partkey)) AS name, max(p_retailprice) AS confidence, arg_min(p_size, p_partkey) FILTER (p_size > 10) AS created_at, max(p_size) AS updated_at, any_value(chunks) AS chunks FROM part JOIN l USING (p_brand) GROUP BY p_brand""")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").alias("name"), F.array("p_type", F.lower("p_type")).alias("chunks"), F.col("p_retailprice").alias("confidence"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("created_at"), F.col("p_size").alias("updated_at"))
    return U.merge_duplicates(p, ["p_brand"], ["name"], ["chunks"], "p_partkey").withColumn("chunks", F.array_join("chunks", ","))


@query(r"""WITH p AS (SELECT *, upper(coalesce(nullif(regexp_extract(p_name, '([A-Za-z]{1,8}\d{2,}[A-Za-z0-9-]*)', 1), ''), nullif(regexp_extract(p_brand, '([A-Za-z]{1,8}\d{2,}[A-Za-z0-9-]*)', 1), ''))) AS f, CASE WHEN p_size > 20 THEN p_name END AS nm FROM part),
k AS (SELECT *, upper(coalesce(nullif(regexp_extract(nm, '([A-Za-z]{1,8}\d{2,}[A-Za-z0-9-]*)', 1), ''), nullif(regexp_extract(p_brand, '([A-Za-z]{1,8}\d{2,}[A-Za-z0-9-]*)', 1), ''))) AS fam FROM p),
m AS (SELECT *, coalesce('FP-FAMILY::' || fam, 'FP-PN::' || nullif(regexp_replace(upper(p_brand), '[\s\-_(),.:;]+', '', 'g'), '')) AS product_key FROM k),
g AS (SELECT product_key, arg_min(coalesce(nm, p_brand), p_partkey) AS canonical_name, arg_min(nm, p_partkey) FILTER (nm IS NOT NULL) AS name, list_distinct(list(nm)) AS names, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS numbers, max(p_retailprice) AS confidence FROM m GROUP BY 1),
c AS (SELECT product_key, string_agg(p_type, ',' ORDER BY place) AS chunks FROM (SELECT product_key, p_type, min(p_partkey) AS place FROM m GROUP BY ALL) GROUP BY 1)
SELECT product_key, canonical_name, name, array_to_string(list_sort(list_distinct(list_append(names, canonical_name))), ',') AS aliases, numbers, chunks, confidence FROM g JOIN c USING (product_key)""")
def product_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("name"), F.col("p_brand").alias("number"), F.array("p_type").alias("supporting_chunks"), F.col("p_retailprice").alias("confidence"))
    return rolled_up(m).select("product_key", "canonical_name", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("numbers", ",").alias("numbers"), F.array_join("supporting_chunks", ",").alias("chunks"), "confidence")


@query("""SELECT o_orderkey, '{"business_key":"O' || o_orderkey || '"' || CASE WHEN o_orderpriority < '3' THEN CASE WHEN o_orderstatus <> 'P' THEN ',"report_status":"' || o_orderstatus || '"' ELSE '' END || ',"owner_name":"' || o_custkey || '"' ELSE '' END || ',"confidence":"1"}' AS summary FROM orders""")
def type_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent and high orders are reports, which show more than other types."""
    props = F.create_map(F.lit("owner_name"), F.col("o_custkey").cast("string"), F.lit("confidence"), F.lit("1"), F.lit("report_status"), F.nullif("o_orderstatus", F.lit("P")), F.lit("internal"), F.lit("x"), F.lit("business_key"), _key("O", "o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.to_json(Q.type_summary(F.when(F.col("o_orderpriority") < "3", "EightDReport").otherwise("Person"), props)).alias("summary"))


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS report_date FROM orders ORDER BY o_orderstatus ASC NULLS LAST, o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 60 OFFSET 60")
def structured_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = Q.Entity("o_orderkey", ("o_orderdate",), ("o_orderstatus",), updated="o_orderdate")
    return Q.structured(load(spark, sf_dir, "orders"), report, {}, sort_by="o_orderstatus", descending=False, page=2, page_size=60).select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"))


@query(f"{SQL_GRAPH} SELECT label AS type, business_key AS id FROM nodes WHERE label = 'Supplier' AND contains(lower(title), '1')")
def search_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph(spark, sf_dir).nodes.withColumn("props", F.create_map(F.lit("title"), "title"))
    return Q.of_type(Q.search_entities(nodes, "1", ["title"]), "Supplier").select("type", "id")


@query("SELECT doc_id, coalesce(lang = 'en', false) AND n_chars > 500 AS team, coalesce(lang = 'fr', false) AS author FROM documents")
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made of documents: English ones have a mail column, long ones a department, French ones an author."""
    headers = F.array(F.lit("姓 名"), F.lit("Reviewed-by"), F.when(F.col("lang") == "en", "E-mail").when(F.col("lang") == "fr", "Author"))
    rows = F.when(F.col("n_chars") > 500, F.array(F.create_map(F.lit("所属部门"), "source"))).otherwise(F.array().cast("array<map<string,string>>"))
    d = load(spark, sf_dir, "documents").select("doc_id", P.table_cells(headers, rows).alias("cells"))
    return d.select("doc_id", P.is_team_table(F.col("cells")).alias("team"), P.is_author_table(F.col("cells")).alias("author"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN doc_id END AS id, CASE WHEN lang IN ('en', 'fr') THEN lang END AS lang FROM documents")
def model_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a think part and a fence, bare ones, and ones that are no JSON."""
    record = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), "lang", F.lit('"}'))
    answer = F.when(F.col("lang") == "en", F.concat(F.lit("<think>a\nb</think>\n```json\n"), record, F.lit("\n```\n"))).when(F.col("lang") == "fr", record).otherwise("no record")
    return load(spark, sf_dir, "documents").select("doc_id", T.payload(answer, "id bigint, lang string").alias("r")).select("doc_id", "r.*")


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS level FROM part WHERE p_partkey BETWEEN 1 AND 9 UNION SELECT root, p_partkey, level + 1 FROM t JOIN part ON p_partkey // 10 = node AND p_partkey > 9)
SELECT root, level, count(*) AS nodes FROM t GROUP BY root, level""")
def part_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below nine parts, where a part belongs to that with its number without the last digit."""
    p = load(spark, sf_dir, "part").select("p_partkey")
    links = p.where("p_partkey > 9").select(F.expr("p_partkey div 10").alias("parent"), F.col("p_partkey").alias("child"))
    return G.descendants(links, p.where("p_partkey BETWEEN 1 AND 9").withColumnRenamed("p_partkey", "root")).groupBy("root", "level").agg(F.count(F.lit(1)).alias("nodes"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'second' WHEN 1 THEN 'minute' WHEN 2 THEN 'day' WHEN 3 THEN 'month' WHEN 4 THEN 'year' END AS precision, CASE WHEN o_orderkey % 6 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def time_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times written down as far as they were known."""
    n = F.get(F.array(*map(F.lit, (19, 16, 10, 7, 4, 0))), (F.col("o_orderkey") % 6).cast("int"))
    raw = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").substr(F.lit(1), n)
    return load(spark, sf_dir, "orders").select("o_orderkey", T.time_precision(raw).alias("precision"), F.date_format(T.time_value(raw), "yyyy-MM-dd").alias("day"))


@query(f"{SQL_GRAPH} SELECT from_key, rel_type, to_key FROM edges ORDER BY CASE rel_type WHEN 'IN_NATION' THEN 0.9 WHEN 'PLACED' THEN 0.8 END DESC NULLS LAST, from_label, from_key, rel_type, to_label, to_key LIMIT 200")
def most_confident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    told = g.edges.withColumn("confidence", F.when(F.col("rel_type") == "IN_NATION", 0.9).when(F.col("rel_type") == "PLACED", 0.8))
    return G.PropertyGraph(g.nodes, told).most_confident(200).select("from_key", "rel_type", "to_key")
