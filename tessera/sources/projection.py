"""Relational tables as a property graph: one branch per label or edge type, so that a filter on
label or rel_type prunes whole branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import PropertyGraph
from tessera.operators.upsert import without_ends
from tessera.plans.tables import load

EPOCH = "2000-01-01 00:00:00"
#: label: (table, key prefix, key column, title column)
LABELS = {
    "Customer": ("customer", "C", "c_custkey", "c_name"),
    "Supplier": ("supplier", "S", "s_suppkey", "s_name"),
    "Part": ("part", "P", "p_partkey", "p_name"),
    "Order": ("orders", "O", "o_orderkey", "o_orderstatus"),
    "Nation": ("nation", "N", "n_nationkey", "n_name"),
    "Region": ("region", "R", "r_regionkey", "r_name"),
}
#: table, from (label, column), type, to (label, column), distinct, time column
RELATIONS = [
    ("customer", ("Customer", "c_custkey"), "IN_NATION", ("Nation", "c_nationkey"), False, None),
    ("supplier", ("Supplier", "s_suppkey"), "IN_NATION", ("Nation", "s_nationkey"), False, None),
    ("nation", ("Nation", "n_nationkey"), "IN_REGION", ("Region", "n_regionkey"), False, None),
    ("orders", ("Customer", "o_custkey"), "PLACED", ("Order", "o_orderkey"), False, "o_orderdate"),
    ("lineitem", ("Order", "l_orderkey"), "CONTAINS", ("Part", "l_partkey"), True, None),
    ("lineitem", ("Part", "l_partkey"), "SUPPLIED_BY", ("Supplier", "l_suppkey"), True, None),
]


def _key(label: str, column: str) -> F.Column:
    return F.concat(F.lit(LABELS[label][1]), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(label: str) -> DataFrame:
        table, _, key, title = LABELS[label]
        df = load(spark, sf_dir, table)
        props = [c for c in df.columns if c != key]
        time = F.col("o_orderdate").cast("timestamp_ntz") if table == "orders" else F.lit(None).cast("timestamp_ntz")
        return df.select(
            F.lit(label).alias("label"), _key(label, key).alias("business_key"), F.col(title).alias("title"),
            F.create_map(*(x for c in props for x in (F.lit(c), F.col(c).cast("string")))).alias("props"),
            F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"), time.alias("updated_at"),
        )

    return reduce(DataFrame.unionByName, map(one, LABELS))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(table, start, kind, end, distinct, time) -> DataFrame:
        df = load(spark, sf_dir, table)
        at = F.col(time).cast("timestamp_ntz") if time else F.lit(None).cast("timestamp_ntz")
        keys = df.select(start[1], end[1], at.alias("updated_at"))
        if distinct:
            keys = keys.distinct()
        return keys.select(
            F.lit(start[0]).alias("from_label"), _key(*start).alias("from_key"), F.lit(kind).alias("rel_type"),
            F.lit(end[0]).alias("to_label"), _key(*end).alias("to_key"), F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"), "updated_at",
        )

    return reduce(DataFrame.unionByName, (one(*r) for r in RELATIONS))


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(nodes(spark, sf_dir), edges(spark, sf_dir))


def dangling(spark: SparkSession, sf_dir: str, kept: dict[str, Column]) -> DataFrame:
    """(from_label, from_key, rel_type, to_label, to_key, missing_from, missing_to): edges with an end that has no row,
    or none for which its label's condition in `kept` holds, and which end. Ends are looked up by the tables' own keys,
    before pairs are made distinct and keys become texts: rows of two numbers are dealt, and of pairs that occur more
    than once only the dangling ones are compared, where the last lookup has dealt them."""

    def there(label: str, column: str) -> DataFrame:
        table, _, key, _ = LABELS[label]
        df = load(spark, sf_dir, table)
        return (df.where(kept[label]) if label in kept else df).select(F.col(key).alias(column))

    def one(table, start, kind, end, distinct, _) -> DataFrame:
        pairs = load(spark, sf_dir, table).select(F.col(start[1]).alias("from_key"), F.col(end[1]).alias("to_key"))
        met = without_ends(pairs, there(start[0], "from_key"), there(end[0], "to_key"))
        return (met.distinct() if distinct else met).select(
            F.lit(start[0]).alias("from_label"), _key(start[0], "from_key").alias("from_key"), F.lit(kind).alias("rel_type"),
            F.lit(end[0]).alias("to_label"), _key(end[0], "to_key").alias("to_key"), "missing_from", "missing_to",
        )

    return reduce(DataFrame.unionByName, (one(*r) for r in RELATIONS))


def duckdb_graph() -> str:
    """The same nodes and edges as SQL common table expressions."""
    n = " UNION ALL ".join(f"SELECT '{label}' AS label, '{p}' || {k} AS business_key, {t} AS title, TIMESTAMP '{EPOCH}' AS created_at, {'o_orderdate' if table == 'orders' else 'NULL'}::TIMESTAMP AS updated_at FROM {table}" for label, (table, p, k, t) in LABELS.items())
    e = " UNION ALL ".join(
        f"SELECT '{a[0]}' AS from_label, '{LABELS[a[0]][1]}' || {a[1]} AS from_key, '{kind}' AS rel_type, '{z[0]}' AS to_label, '{LABELS[z[0]][1]}' || {z[1]} AS to_key, TIMESTAMP '{EPOCH}' AS created_at, {time or 'NULL'}::TIMESTAMP AS updated_at FROM {f'(SELECT DISTINCT {a[1]}, {z[1]} FROM {table})' if distinct else table}"
        for table, a, kind, z, distinct, time in RELATIONS
    )
    return f"nodes AS ({n}), edges AS ({e})"
