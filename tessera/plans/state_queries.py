"""States over time: runs, as-of reads, kept aggregates, and subgraphs by confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import temporal as A
from tessera.operators.graph import PropertyGraph
from tessera.operators.materialized import Aggregates, changes
from tessera.plans.catalog import query
from tessera.plans.tables import load, python_path
from tessera.sources.projection import duckdb_graph, graph
from tessera.streaming.runs import run_states

HOURS = 6
_OVER = f"status = 'running' AND n.ms > started + {HOURS * 3_600_000}"


@query(f"""WITH RECURSIVE c AS (SELECT user_id || '-' || strftime(ts, '%d') AS run_id, epoch_ms(ts) AS ms, event_id, CASE event_type WHEN 'signup' THEN 'trigger' WHEN 'view' THEN 'start' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'cancel' ELSE 'retry' END ELSE 'result' END AS kind, CASE event_type WHEN 'error' THEN 'E' END AS err FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ms, event_id) AS i FROM c),
s AS (SELECT DISTINCT run_id, 0::BIGINT AS i, NULL::VARCHAR AS status, NULL::INT AS attempt, NULL::BIGINT AS started, NULL::BOOLEAN AS cancelled, NULL::VARCHAR AS error, 0 AS refused FROM n
UNION ALL SELECT run_id, i, CASE WHEN NOT ok THEN st WHEN kind IN ('trigger', 'retry') THEN 'pending' WHEN kind = 'start' THEN 'running' WHEN kind = 'result' AND err IS NULL THEN 'success' ELSE 'failed' END,
 CASE WHEN ok AND kind = 'trigger' THEN 1 WHEN ok AND kind = 'retry' AND st = 'failed' THEN attempt + 1 ELSE attempt END, CASE WHEN ok AND kind = 'start' THEN ms WHEN ok AND kind = 'retry' AND st = 'failed' THEN NULL ELSE started END,
 CASE WHEN ok AND kind = 'cancel' THEN true WHEN ok AND (kind = 'trigger' OR (kind = 'retry' AND st = 'failed')) THEN false ELSE cancelled END, CASE WHEN ok AND kind = 'result' THEN err WHEN ok AND kind = 'retry' AND st = 'failed' THEN NULL ELSE er END, CASE WHEN ok THEN refused ELSE refused + 1 END
FROM (SELECT *, coalesce(CASE kind WHEN 'trigger' THEN st IS NULL WHEN 'start' THEN st = 'pending' WHEN 'result' THEN st = 'running' WHEN 'cancel' THEN st IN ('pending', 'running') ELSE st IN ('pending', 'failed') END, false) AS ok
 FROM (SELECT s.run_id, n.i, n.ms, n.kind, n.err, attempt, started, cancelled, refused, CASE WHEN {_OVER} THEN 'failed' ELSE status END AS st, CASE WHEN {_OVER} THEN 'timeout' ELSE error END AS er FROM s JOIN n ON n.run_id = s.run_id AND n.i = s.i + 1)))
SELECT run_id, CASE WHEN status = 'running' AND epoch_ms(TIMESTAMP '2024-02-15') > started + {HOURS * 3_600_000} THEN 'failed' ELSE status END AS status, attempt, cancelled, CASE WHEN status = 'running' AND epoch_ms(TIMESTAMP '2024-02-15') > started + {HOURS * 3_600_000} THEN 'timeout' ELSE error END AS error, refused
FROM s WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i DESC) = 1""")
def run_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as the commands of a run: what each run is in the end."""
    python_path(spark)
    e, kind = load(spark, sf_dir, "events"), F.col("event_type")
    told = F.when(kind == "signup", "trigger").when(kind == "view", "start").when(kind == "click", F.when(F.col("event_id") % 2 == 0, "cancel").otherwise("retry")).otherwise("result")
    commands = e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), told.alias("kind"), F.when(kind == "error", "E").alias("error"))
    return run_states(commands, F.lit("2024-02-15").cast("timestamp_ntz"), limit=HOURS * 3600).select("run_id", "status", "attempt", "cancelled", "error", "refused")


@query("""WITH s AS (SELECT user_id, ts AS since, event_type, value, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type <> 'view')
SELECT v.event_id, s.event_type AS held, s.event_id AS held_by FROM events v ASOF LEFT JOIN (SELECT user_id, since, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM s GROUP BY 1, 2) s ON s.user_id = v.user_id AND s.since <= v.ts WHERE v.event_type = 'view'""")
def as_of_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every view, the last other event of its user up to then."""
    e = load(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    states = e.where("event_type <> 'view'").select("user_id", F.col("ts").alias("since"), F.col("event_type").alias("held"), F.col("event_id").alias("held_by"))
    return A.as_of(views, states, "user_id", "ts", "since", order="held_by").select("event_id", "held", "held_by")


@query("""WITH v AS (SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events),
t AS (SELECT unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, date_trunc('day', max(ts))::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM events), x AS (SELECT DISTINCT user_id FROM events)
SELECT x.user_id, t.day, v.event_type AS held FROM x, t LEFT JOIN v ON v.user_id = x.user_id AND v.valid_from <= t.day AND (v.valid_to IS NULL OR v.valid_to > t.day)""")
def states_each_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's state was at the beginning of every day: many times at once."""
    e = load(spark, sf_dir, "events")
    states = A.intervals(e.select("user_id", "event_type", "ts", "event_id"), "user_id", "ts", "event_id")
    first, last = e.agg(F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts"))).first()
    days = F.expr(f"sequence(TIMESTAMP_NTZ '{first}', TIMESTAMP_NTZ '{last}', INTERVAL 1 DAY)")
    times = e.select("user_id").distinct().select("user_id", F.explode(days).alias("at"))
    return A.as_of(times, states, "user_id", "at", "valid_from", until="valid_to", order="event_id").select("user_id", F.col("at").alias("day"), F.col("event_type").alias("held"))


# Orders are placed at their date and hold for ninety days; what belongs to none holds for good.
_UNTIL = "updated_at + INTERVAL 90 DAY"


@query(f"""WITH {duckdb_graph()}, e AS (SELECT * FROM edges WHERE updated_at IS NULL OR (updated_at <= TIMESTAMP '1997-01-01' AND {_UNTIL} > TIMESTAMP '1997-01-01')),
l AS (SELECT from_label AS label, from_key AS key, to_label, to_key FROM e UNION ALL SELECT to_label, to_key, from_label, from_key FROM e),
d1 AS (SELECT DISTINCT to_label AS label, to_key AS business_key FROM l WHERE label = 'Nation' AND key = 'N1'), d2 AS (SELECT DISTINCT to_label AS label, to_key AS business_key FROM l JOIN d1 ON d1.label = l.label AND d1.business_key = l.key),
a AS (SELECT 'Nation' AS label, 'N1' AS business_key, 0 AS distance UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2)
SELECT label, business_key, min(distance)::INT AS distance FROM a GROUP BY ALL""")
def subgraph_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps round a nation by the edges that held on one day."""
    g = graph(spark, sf_dir)
    edges = g.edges.withColumns({"valid_from": F.col("updated_at"), "valid_to": F.expr(_UNTIL)})
    return PropertyGraph(g.nodes, edges).as_of(F.lit("1997-01-01").cast("timestamp_ntz")).neighbourhood("Nation", "N1", 2)


_SURE = "0.5 + ((CAST(substr(from_key, 2) AS BIGINT) * 31 + CAST(substr(to_key, 2) AS BIGINT) * 17) % 50) / 100.0"


def _steps(n: int) -> str:
    out = ["h0 AS (SELECT 'Customer' AS label, 'C1' AS business_key, 1.0::DOUBLE AS confidence, 0 AS hops)"]
    for k in range(1, n + 1):
        met = f"SELECT b AS label, bk AS business_key, max(confidence * sure) AS confidence, {k} AS hops FROM l JOIN h{k - 1} h ON h.label = l.a AND h.business_key = l.ak GROUP BY b, bk"
        out.append(f"h{k} AS (SELECT * FROM (SELECT * FROM h{k - 1} UNION ALL {met}) QUALIFY row_number() OVER (PARTITION BY label, business_key ORDER BY confidence DESC, hops) = 1)")
    return ", ".join(out)


@query(f"""WITH {duckdb_graph()}, e AS (SELECT *, ({_SURE})::DOUBLE AS sure FROM edges), l AS (SELECT from_label AS a, from_key AS ak, to_label AS b, to_key AS bk, sure FROM e UNION ALL SELECT to_label, to_key, from_label, from_key, sure FROM e), {_steps(3)}
SELECT label, business_key, round(confidence, 9) AS confidence, hops FROM h3 ORDER BY h3.confidence DESC, hops, label, business_key LIMIT 200""")
def confident_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 nodes around a customer that the surest paths of three steps lead to."""
    g = graph(spark, sf_dir)
    return PropertyGraph(g.nodes, g.edges.withColumn("confidence", F.expr(_SURE).cast("double"))).confident("Customer", "C1", 3, 200)[0].select("label", "business_key", F.round("confidence", 9).alias("confidence"), "hops")


@query(f"""WITH {duckdb_graph()}, e AS (SELECT from_label, from_key, to_label, to_key FROM edges WHERE rel_type IN ('IN_NATION', 'IN_REGION')),
d1 AS (SELECT DISTINCT from_label AS label, from_key AS business_key FROM e WHERE to_label = 'Region' AND to_key = 'R1'), d2 AS (SELECT DISTINCT from_label AS label, from_key AS business_key FROM e JOIN d1 ON d1.label = to_label AND d1.business_key = to_key)
SELECT label, business_key, distance FROM (SELECT *, 1 AS distance FROM d1 UNION ALL SELECT *, 2 FROM d2) ORDER BY distance, label, business_key LIMIT 100""")
def neighbours_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leads into a region by two types of edges, within two steps."""
    return graph(spark, sf_dir).neighbours("Region", "R1", "in", ["IN_NATION", "IN_REGION"], 2, 100)


_AFTER = """i AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'N' ELSE l_returnflag END AS g, 'P' || (l_partkey % 50) AS cause, CAST(l_quantity AS BIGINT) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS cost FROM lineitem WHERE l_orderkey % 7 <> 0 OR l_orderkey % 5 = 0)"""


@query(f"""WITH {_AFTER}, n AS (SELECT g, count(*) AS n, sum(cost)::BIGINT AS total, count(DISTINCT cause) AS causes FROM i GROUP BY g), c AS (SELECT g, cause, count(*) AS times FROM i GROUP BY g, cause)
SELECT g, n, total, causes, cause, times, (row_number() OVER (PARTITION BY g ORDER BY times DESC, cause))::INT AS rank FROM c JOIN n USING (g) QUALIFY rank <= 5""")
def kept_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums, distinct causes and the five leading ones of each group, kept while a seventh of the items is
    deleted and a fifth replaced."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("cause"), F.col("l_quantity").cast("bigint").alias("cost"))
    view = Aggregates.of(rows, ("g",), "cause", "cost", top=5, spare=5)
    new = rows.where("l_orderkey % 5 = 0").withColumns({"g": F.lit("N"), "cost": F.col("cost") + 1})
    view = view.applied(changes(rows.where("l_orderkey % 7 = 0"), new, ["l_orderkey", "l_linenumber"], rows))
    n = view.counts.join(view.distinct().withColumnRenamed("values", "causes"), "g")
    return n.join(view.best().withColumnRenamed("n", "times"), "g").select("g", "n", "total", "causes", "cause", "times", "rank")
