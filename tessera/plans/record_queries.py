"""Structured queries, lists, dashboards, upserts and windows over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import upsert as U
from tessera.operators import query as Q
from tessera.operators.query import Entity, matching, structured
from tessera.plans.catalog import query
from tessera.plans.tables import load
from tessera.streaming import events as E

REPORT = Entity("o_orderkey", ("o_orderdate",), ("o_orderstatus", "o_orderpriority"))
EVENT = Entity("event_id", ("ts",), ("event_type",))
ACTION = Entity("key", ("l_shipdate",), ("l_linestatus", "l_returnflag"))
REPORT_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


def _reports(spark: SparkSession, sf_dir: str, **k) -> DataFrame:
    return structured(load(spark, sf_dir, "orders"), REPORT, **k).select(*REPORT_COLUMNS, F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"))


_REPORT_SQL = "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS report_date FROM orders"


@query(f"{_REPORT_SQL} WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 50")
def structured_report_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir, filters={"o_orderdate_from": "1995-01-01", "o_orderdate_to": "1996-12-31", "event_type": "ignored"}, page_size=50)


@query(f"{_REPORT_SQL} WHERE o_orderstatus = 'O' ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 30")
def structured_report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir, filters={"o_orderstatus": "O", "o_orderpriority": ""}, sort_by="o_totalprice", descending=False, page_size=30)


@query(f"{_REPORT_SQL} ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 25")
def structured_report_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir, filters={}, page=2, page_size=25)


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC NULLS FIRST, event_id LIMIT 100")
def structured_event_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured(load(spark, sf_dir, "events"), EVENT, {"event_type": "error", "ts_from": "2024-01-05", "ts_to": "2024-01-20"}, page_size=100).select("event_id", "event_type", "value")


@query("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, l_quantity FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' ORDER BY l_shipdate DESC NULLS FIRST, key LIMIT 40 OFFSET 80")
def structured_action_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return structured(df, ACTION, {"l_linestatus": "O", "l_returnflag": "N"}, page=3, page_size=40).select("key", "l_quantity")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-06-01'")
def structured_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(load(spark, sf_dir, "orders"), REPORT, {"o_orderstatus": "F", "o_orderdate_from": "1995-06-01"}).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT l.doc_id, quality, toxic, coalesce(source, '') AS source, n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def runs_with_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return load(spark, sf_dir, "labels").join(d, "doc_id", "left").select("doc_id", "quality", "toxic", F.coalesce("source", F.lit("")).alias("source"), "n_chars")


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS active, bool_and(o_orderstatus = 'F') AS all_finished FROM orders")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return load(spark, sf_dir, "orders").agg(F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("finished"), F.count_if(s.isin("O", "P")).alias("active"), F.bool_and(s == "F").alias("all_finished"))


@query("SELECT p_brand, n, round(100.0 * n / max(n) OVER (), 4) AS percent FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 8)")
def label_bars_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(8)
    return top.withColumn("percent", F.round(100.0 * F.col("n") / F.max("n").over(Window.partitionBy()), 4))  # eight rows


@query("""WITH new AS (SELECT c_custkey + 5 AS k, c_name || '*' AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal + 1 END AS bal FROM customer)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(name, c_name) AS c_name, round(coalesce(bal, c_acctbal), 2) AS c_acctbal, c_mktsegment FROM customer FULL JOIN new ON k = c_custkey""")
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = old.select((F.col("c_custkey") + 5).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") + 1).alias("c_acctbal"))
    return U.upsert(old, new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""WITH old AS (SELECT 'A' || c_custkey AS business_key, c_mktsegment AS segment FROM customer), new AS (SELECT 'A' || (s_suppkey * 3) AS business_key, s_name AS name FROM supplier)
SELECT coalesce(o.business_key, n.business_key) AS business_key, segment, name, CASE WHEN o.business_key IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created_on, CASE WHEN o.business_key IS NOT NULL AND n.business_key IS NOT NULL THEN '2024-02-01' END AS updated_on FROM old o FULL JOIN new n USING (business_key)""")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    key = lambda c: F.concat(F.lit("A"), c.cast("string")).alias("business_key")
    old = load(spark, sf_dir, "customer").select(F.lit("Account").alias("label"), key(F.col("c_custkey")), F.create_map(F.lit("segment"), "c_mktsegment").alias("props"), time("2024-01-01").alias("created_at"), time(None).alias("updated_at"))
    new = load(spark, sf_dir, "supplier").select(F.lit("Account").alias("label"), key(F.col("s_suppkey") * 3), F.create_map(F.lit("name"), "s_name").alias("props"), time("2024-02-01").alias("at"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return U.merge_nodes(old, new).select("business_key", F.try_element_at("props", F.lit("segment")).alias("segment"), F.try_element_at("props", F.lit("name")).alias("name"), day("created_at").alias("created_on"), day("updated_at").alias("updated_on"))


@query("""WITH old AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL), new AS (SELECT l_orderkey, l_linenumber + 1 AS l_linenumber, l_quantity FROM old JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
SELECT * FROM old WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    again = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = old.join(again, "l_orderkey", "left_semi").withColumn("l_linenumber", F.col("l_linenumber") + 1)
    return U.replace_children(old, new, "l_orderkey", ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS seen FROM events GROUP BY user_id, event_type")
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("seen"))


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, max(l_quantity) AS best, min(l_shipdate)::DATE::VARCHAR AS first_seen, max(l_shipdate)::DATE::VARCHAR AS last_seen FROM lineitem GROUP BY l_partkey")
def rollup_best_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.max("l_quantity").alias("best"), day(F.min("l_shipdate")).alias("first_seen"), day(F.max("l_shipdate")).alias("last_seen"))


@query("WITH o AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, CASE WHEN n = 1 THEN s END AS only_supplier FROM orders LEFT JOIN o ON l_orderkey = o_orderkey")
def exactly_one_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    one = pairs.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    return load(spark, sf_dir, "orders").select("o_orderkey").join(one, "o_orderkey", "left").select("o_orderkey", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only_supplier"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(load(spark, sf_dir, "events")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM g GROUP BY user_id, n""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(load(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query("SELECT user_id, event_type AS current_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each position from its history: the latest event (aggregated, not windowed)."""
    last = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", F.col("e.event_type").alias("current_type"), F.col("e.value").alias("value"))


@query("""WITH v AS (SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)
SELECT user_id, event_type FROM v WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')""")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What held at a time: each state is valid until the next one of its position."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = load(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    return v.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("user_id", "event_type")


@query("SELECT o_orderpriority, o_orderstatus, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS g, count(*) AS runs FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders")
    return df.rollup("o_orderpriority", "o_orderstatus").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("runs"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE o_orderstatus END AS status, o_orderstatus IN ('O', 'P') AS accepted FROM orders")
def cancel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise(F.col("o_orderstatus")).alias("status"), F.lit(None).cast("boolean").alias("cancelled"))
    return U.next_status(runs, "cancel").select("o_orderkey", "status", "accepted")


@query("SELECT e.event_id AS run_id, e.user_id AS document_id, ts AS started_at, source AS file_name FROM events e LEFT JOIN documents ON doc_id = user_id + 60 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50")
def runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of runs, newest first, with the files of those documents that are known."""
    runs = load(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("document_id"), F.col("ts").alias("started_at"))
    d = load(spark, sf_dir, "documents").select((F.col("doc_id") - 60).alias("document_id"), F.col("source").alias("file_name"))
    return Q.runs_page(runs, d, 2, 50)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 60")
def structured_text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of times that are texts, a third of which are none."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.col("o_orderdate").cast("string")).alias("o_orderdate"))
    return structured(o, REPORT, {"o_orderdate_from": "1995-01-01", "o_orderdate_to": "1996-06-01"}, page_size=60).select("o_orderkey")


@query("""WITH old AS (SELECT min(doc_id) AS document_id, sha256(text) AS sha256, 'done' AS status, min(n_chars) AS file_size FROM documents WHERE doc_id % 2 = 0 GROUP BY text),
new AS (SELECT min(doc_id) AS document_id, sha256(text) AS sha256, arg_max(lang, doc_id) AS status, arg_max(n_chars, doc_id) AS file_size FROM documents GROUP BY text)
SELECT coalesce(old.document_id, new.document_id) AS document_id, sha256, new.status AS status, new.file_size AS file_size FROM new LEFT JOIN old USING (sha256)""")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come where every second content is known already."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("status"), F.col("n_chars").alias("file_size"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    old = d.where("document_id % 2 = 0").groupBy("sha256").agg(F.min("document_id").alias("document_id"), F.lit("done").alias("status"), F.min("file_size").alias("file_size"), F.lit("2023-01-01").cast("timestamp").alias("updated_at"))
    return U.upsert_documents(old, d)[0].select("document_id", "sha256", "status", "file_size")
