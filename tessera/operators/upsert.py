"""Idempotent upserts, replacements and deletions: each returns the table's next state.

Plain parquet has no MERGE; a caller writes the returned DataFrame as the next version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: keys of up to so many nodes are broadcast to edges
FEW = 1000
#: edges of a part in which they meet their ends
PART_EDGES = 1_250_000


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of new overwrite what they carry: a null in new leaves the old value. `keep` columns take
    the old value where there is one. Both sides hold a key at most once."""
    n = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_is_new"))
    both = old.join(n, keys, "full_outer")
    out = [*keys]
    for c in old.columns:
        if c in keys:
            continue
        if c not in new.columns:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.coalesce(c, f"_new_{c}").alias(c))
        else:
            out.append(F.coalesce(f"_new_{c}", c).alias(c))
    return both.select(*out)


def upsert_documents(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, ids) after new documents(document_id, sha256, status, file_size, updated_at, ...) have come. A
    content that is there keeps its row and id and takes status, size and time; of new rows with one content the first
    by id makes the row, the last by time and id gives those three. ids(document_id, sha256, kept_id) leads each new
    row to the id under which its content is kept."""
    told = ["status", "file_size", "updated_at"]
    rest = [c for c in old.columns if c not in ("sha256", *told)]
    first = new.groupBy("sha256").agg(F.min_by(F.struct(*rest), "document_id").alias("f"), F.max_by(F.struct(*told), F.struct("updated_at", "document_id")).alias("t"))
    both = old.join(first, "sha256", "full_outer")
    kept = both.select("sha256", *(F.when(F.col("document_id").isNull(), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in rest), *(F.when(F.col("t").isNotNull(), F.coalesce(f"t.{c}", c)).otherwise(F.col(c)).alias(c) for c in told))
    ids = new.select("document_id", "sha256").join(kept.select("sha256", F.col("document_id").alias("kept_id")), "sha256")
    return kept.select(old.columns), ids.select("document_id", "sha256", "kept_id")


def merge_properties(old: str, new: str) -> F.Column:
    """A property map with new's keys over old's (map_concat refuses equal keys)."""
    o, n = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def _merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    n = new.select(*keys, F.col("props").alias("_props"), F.col("at").alias("_at"))
    both = old.join(n, keys, "full_outer")
    return both.select(
        *keys, merge_properties("props", "_props").alias("props"), F.coalesce("created_at", "_at").alias("created_at"),
        F.when(F.col("created_at").isNotNull() & F.col("_at").isNotNull(), F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(label, business_key, props, created_at, updated_at): created on first sight, else properties
    are overwritten and updated_at is set."""
    return _merged(old, new, ["label", "business_key"])


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by the same rule: new(from_label, from_key, rel_type, to_label, to_key, props, at) are
    created or overwrite properties where both ends are nodes, else nothing happens. Both sides hold
    an edge of one type between the same ends at most once."""
    return _merged(old, with_both_ends(new, nodes), ["from_label", "from_key", "rel_type", "to_label", "to_key"])


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    a = nodes.select(F.col("label").alias("from_label"), F.col("business_key").alias("from_key"))
    b = nodes.select(F.col("label").alias("to_label"), F.col("business_key").alias("to_key"))
    return edges.join(a, ["from_label", "from_key"], "left_semi").join(b, ["to_label", "to_key"], "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which end."""
    return without_ends(edges, *(nodes.select(F.col("label").alias(f"{side}_label"), F.col("business_key").alias(f"{side}_key")) for side in ("from", "to")))


def without_ends(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges with an end that is not there, and which: starts and ends hold the keys that are, under the names of the
    edges' columns. Edges are dealt once for each end, at every size, so that what is shuffled grows with the rows;
    Spark would choose by the size of compressed files, which says little of the keys in them. The number of parts
    grows with the edges, which are counted first, so that a part is sorted in memory. Up to FEW keys are broadcast."""
    spark = edges.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // PART_EDGES))
    for keys, mark in ((starts, "missing_from"), (ends, "missing_to")):
        on, there = keys.columns, F.lit(True).alias("_there")
        if keys.limit(FEW + 1).count() <= FEW:
            met = edges.join(F.broadcast(keys.distinct().select("*", there)), on, "left")
        else:
            met = edges.repartition(parts, *on).join(keys.repartition(parts, *on).distinct().select("*", there).hint("merge"), on, "left")
        edges = met.withColumn(mark, F.col("_there").isNull()).drop("_there")
    return edges.where("missing_from OR missing_to")


def replace_children(old: DataFrame, new: DataFrame, parent: str, unique: list[str]) -> DataFrame:
    """The children of every parent in new are replaced; a new row whose unique key another parent's
    row already has is left out, as is a second new row with the same key."""
    rest = old.join(new.select(parent).distinct(), parent, "left_anti")
    first = new.groupBy(*unique).agg(F.min_by(F.struct(*new.columns), F.struct(*[c for c in new.columns if c not in unique])).alias("r")).select("r.*")
    return rest.unionByName(first.join(rest.select(*unique), unique, "left_anti").select(old.columns))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes `gone` (label, business_key) and their edges."""
    a = gone.select(F.col("label").alias("from_label"), F.col("business_key").alias("from_key"))
    b = gone.select(F.col("label").alias("to_label"), F.col("business_key").alias("to_key"))
    return nodes.join(gone, ["label", "business_key"], "left_anti"), edges.join(a, ["from_label", "from_key"], "left_anti").join(b, ["to_label", "to_key"], "left_anti")


def keep_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of the parts; of rows with equal keys the one of the earliest part stays."""
    ranked = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, ranked)
    rest = [c for c in parts[0].columns if c not in keys]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_part", *rest)).alias("b")) if rest else every.select(*keys).distinct()
    return best.select(*keys, "b.*") if rest else best


def longest(c: str, ordinal: str) -> F.Column:
    """The longest text of a group; of equals the first."""
    return F.max_by(c, F.struct(F.length(F.trim(F.col(c))), -F.col(ordinal)))


def next_status(df: DataFrame, action: str) -> DataFrame:
    """Runs after cancel (pending or running become failed and cancelled) or retry (pending are queued
    again, failed ones start anew); others are refused and stay."""
    if action == "cancel":
        open_ = F.col("status").isin("pending", "running")
        return df.withColumn("accepted", open_).withColumn("cancelled", open_ | F.coalesce("cancelled", F.lit(False))).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))
    if action == "retry":
        again = F.col("status").isin("pending", "failed")
        return df.withColumn("accepted", again).withColumn("new_run", F.col("status") == "failed").withColumn("status", F.when(again, "pending").otherwise(F.col("status")))
    raise ValueError(action)


def ordered_union(rows: DataFrame, keys: list[str], column: str, ordinal: str) -> DataFrame:
    """(keys, column): the distinct non-empty values of a group's lists in the order in which they first
    come. Repeats go before the lists meet, so a hot group holds its distinct values only."""
    one = rows.select(*keys, ordinal, F.posexplode(column).alias("_pos", "_value")).where("_value <> ''")
    first = one.groupBy(*keys, "_value").agg(F.min(F.struct(ordinal, "_pos")).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda s: s["_value"]).alias(column))


def merge_duplicates(rows: DataFrame, keys: list[str], texts: list[str], lists: list[str], ordinal: str, more: list[F.Column] | None = None) -> DataFrame:
    """One row per key: of each text the longest (of equals the first by ordinal), of each list the
    ordered union (empty if there is none), the highest confidence, the first created_at that is set and
    the latest updated_at; `more` are other aggregates. Texts are stripped; blank ones count as none."""
    shown = rows.withColumns({c: F.nullif(T.strip(F.col(c)), F.lit("")) for c in texts})
    aggregates = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col(ordinal)))).alias(c) for c in texts]
    aggregates += [F.max("confidence").alias("confidence"), F.min_by("created_at", F.when(F.col("created_at").isNotNull(), F.col(ordinal))).alias("created_at"), F.max("updated_at").alias("updated_at"), *(more or [])]
    out = shown.groupBy(*keys).agg(*aggregates)
    for c in lists:
        out = out.join(ordered_union(rows, keys, c, ordinal), keys, "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """(label, business_key, n) of keys that more than one node has: empty where the constraint holds."""
    return nodes.where("business_key IS NOT NULL").groupBy("label", "business_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
