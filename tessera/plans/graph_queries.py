"""Queries over the property graph of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import upsert as U
from tessera.operators.rules import remap_edges
from tessera.plans.catalog import ORACLE, QUERIES, query
from tessera.plans.tables import load
from tessera.sources.projection import dangling, duckdb_graph, graph

G = "WITH RECURSIVE " + duckdb_graph()
CENTRE = ("Customer", "C1")
SYM = "sym AS (SELECT from_label AS l, from_key AS k, to_label AS tl, to_key AS tk FROM edges UNION SELECT to_label, to_key, from_label, from_key FROM edges)"


def reach(depth: int) -> str:
    """CTEs of the nodes within depth of the centre."""
    steps = [f"d0 AS (SELECT label, business_key, 0 AS distance FROM nodes WHERE label = '{CENTRE[0]}' AND business_key = '{CENTRE[1]}')"]
    for d in range(1, depth + 1):
        steps.append(f"d{d} AS (SELECT label, business_key, min(distance) AS distance FROM (SELECT * FROM d{d - 1} UNION ALL SELECT sym.tl, sym.tk, {d} FROM d{d - 1} JOIN sym ON sym.l = label AND sym.k = business_key) GROUP BY ALL HAVING true)".replace("GROUP BY ALL HAVING true", "GROUP BY label, business_key"))
    return f"{G}, {SYM}, " + ", ".join(steps)


@query(f"{G} SELECT label, count(*) AS nodes FROM nodes GROUP BY label")
def graph_stats_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).node_counts()


@query(f"{G} SELECT rel_type, count(*) AS edges FROM edges GROUP BY rel_type")
def graph_stats_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edge_counts()


@query(f"{G} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE label = 'Order') AS reports")
def graph_stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    n = g.node_counts().agg(F.sum("nodes").alias("nodes"), F.sum(F.when(F.col("label") == "Order", F.col("nodes"))).alias("reports"))
    return n.join(g.edge_counts().agg(F.sum("edges").alias("edges"))).select("nodes", "edges", "reports")  # one row each


@query(f"""{G}, deg AS (SELECT from_key AS k FROM edges WHERE from_label = 'Customer' UNION ALL SELECT to_key FROM edges WHERE to_label = 'Customer'),
c AS (SELECT k, count(*) AS degree FROM deg GROUP BY k)
SELECT business_key, coalesce(title, business_key) AS title, coalesce(degree, 0)::BIGINT AS degree FROM nodes LEFT JOIN c ON k = business_key WHERE label = 'Customer' ORDER BY degree DESC, updated_at DESC NULLS FIRST, business_key LIMIT 20""")
def graph_centers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).centres("Customer", 20).select("business_key", "title", "degree")


def _nodes_at(depth: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph(spark, sf_dir).neighbourhood(*CENTRE, depth)

    return run


for _d in range(5):
    QUERIES[f"subgraph_nodes_d{_d}"] = _nodes_at(_d)
    ORACLE[f"subgraph_nodes_d{_d}"] = f"{reach(_d)} SELECT label, business_key, distance FROM d{_d}"


@query(f"{reach(2)} SELECT from_label, from_key, rel_type, to_label, to_key FROM edges WHERE (from_label, from_key) IN (SELECT (label, business_key) FROM d2) AND (to_label, to_key) IN (SELECT (label, business_key) FROM d2)")
def subgraph_edges_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).subgraph(*CENTRE, 2)[1].select("from_label", "from_key", "rel_type", "to_label", "to_key")


@query(f"{reach(2)} SELECT label, business_key, distance FROM d2 WHERE label <> 'Nation'")
def subgraph_exclude_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).subgraph(*CENTRE, 2, exclude=("Nation",))[0]


@query(f"{G} SELECT from_label, from_key, rel_type, to_label, to_key FROM edges WHERE from_label <> 'Part' AND to_label <> 'Part' ORDER BY coalesce(updated_at, created_at) DESC NULLS FIRST, from_label, from_key, rel_type, to_label, to_key LIMIT 600")
def global_graph_latest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).latest(600, exclude=("Part",)).select("from_label", "from_key", "rel_type", "to_label", "to_key")


@query(f"{G} SELECT 'out' AS direction, rel_type, to_label AS label, to_key AS business_key FROM edges WHERE from_label = 'Supplier' AND from_key = 'S1' UNION ALL SELECT 'in', rel_type, from_label, from_key FROM edges WHERE to_label = 'Supplier' AND to_key = 'S1'")
def incident_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).incident("Supplier", "S1")


@query(f"""{G} SELECT e.from_key, e.rel_type, e.to_key, a.title AS from_title, b.title AS to_title FROM edges e JOIN nodes a ON a.label = e.from_label AND a.business_key = e.from_key JOIN nodes b ON b.label = e.to_label AND b.business_key = e.to_key
WHERE e.rel_type IN ('IN_NATION', 'IN_REGION') AND e.from_label IN ('Customer', 'Supplier', 'Nation') AND e.to_label IN ('Nation', 'Region')
AND (contains(lower(e.from_key), 'c12') OR contains(lower(e.to_key), 'c12') OR contains(lower(a.title), 'c12') OR contains(lower(b.title), 'c12'))""")
def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).explore(["Customer", "Supplier", "Nation", "Region"], ["IN_NATION", "IN_REGION"], "C12").select("from_key", "rel_type", "to_key", "from_title", "to_title")


@query(f"""{G}, kept AS (SELECT * FROM nodes WHERE NOT (label = 'Part' AND business_key IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 40))),
e AS (SELECT e.*, a.label IS NULL AS missing_from, b.label IS NULL AS missing_to FROM edges e LEFT JOIN kept a ON a.label = from_label AND a.business_key = from_key LEFT JOIN kept b ON b.label = to_label AND b.business_key = to_key)
SELECT from_key, rel_type, to_key, missing_from, missing_to FROM e WHERE missing_from OR missing_to""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = {"Part": F.coalesce(F.col("p_size") <= 40, F.lit(True))}
    return dangling(spark, sf_dir, kept).select("from_key", "rel_type", "to_key", "missing_from", "missing_to")


@query(f"{G}, gone AS (SELECT label, business_key FROM nodes WHERE label = 'Order' AND title = 'F') SELECT rel_type, count(*) AS edges FROM edges WHERE (from_label, from_key) NOT IN (SELECT (label, business_key) FROM gone) AND (to_label, to_key) NOT IN (SELECT (label, business_key) FROM gone) GROUP BY rel_type")
def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    gone = g.with_label("Order").where("title = 'F'").select("label", "business_key")
    return U.detach_delete(g.nodes, g.edges, gone)[1].groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT 'C' || c_custkey AS from_key, 'N-' || r_name AS to_key FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'S' || s_suppkey, 'N-' || r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def remap_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph(spark, sf_dir).edges.where("rel_type = 'IN_NATION'")
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    remap = n.select(F.lit("Nation").alias("label"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("old_key"), F.concat(F.lit("N-"), "r_name").alias("new_key"))
    return remap_edges(e, remap).select("from_key", "to_key")


@query("""WITH l AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS actions,
 count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS preventive FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, c_name AS reporter, n_name AS site, coalesce(parts, 0)::BIGINT AS parts, coalesce(suppliers, 0)::BIGINT AS suppliers, coalesce(actions, 0)::BIGINT AS actions, coalesce(preventive, 0)::BIGINT AS preventive
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def report_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per urgent report: who reported it and where, its parts, suppliers and actions."""
    o = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    items = load(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    per = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("actions"), F.count_if(F.col("l_returnflag") == "R").alias("preventive"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("reporter"), F.col("c_nationkey").alias("n_nationkey"))
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("site"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return o.join(c, "o_custkey", "left").join(n, "n_nationkey", "left").join(per, "o_orderkey", "left").select("o_orderkey", "reporter", "site", *map(zero, ("parts", "suppliers", "actions", "preventive")))
