"""Connected components and chains by pointer jumping: rounds grow with the logarithm of the longest path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.tables import checkpointed

#: nodes that are sent to all others instead of being dealt with them
FEW = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of edges(a, b) reaches. Every round a node takes the least
    label around it (pre-aggregated, so a node with very many neighbours is no hot key) and then its label's."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = checkpointed(both)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    labels = checkpointed(labels)
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(around.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        onward = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = checkpointed(near.join(onward, "component", "left").select("id", "was", F.least("component", F.coalesce("next", "component")).alias("component")))
        labels = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return labels


def chains(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, chain, place, cyclic) of links(source, target): the chains in which one node leads to the next.

    A node's place is its distance from the start of its chain, after which the chain is named; starts have the
    place 0. Of several sources of a node the least holds. Pointers double each round, so a chain of n nodes takes
    log2(n) rounds. Those that have arrived are written once and only looked up from then on. After s steps, n nodes
    that have not arrived are at most s + n - 1 steps from their start, as all of a chain's nodes from its s-th on are
    among them: one that still has somewhere to go when that many steps are made is on a cycle or behind one, and is
    told so, with neither chain nor place. nodes(node) adds nodes without links."""
    previous = links.where("source IS NOT NULL AND target IS NOT NULL").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("to"))
    every = links.select(F.col("source").alias("node")).unionByName(links.select(F.col("target").alias("node")))
    every = (every.unionByName(nodes.select("node")) if nodes is not None else every).where("node IS NOT NULL").distinct()
    state = checkpointed(every.join(previous, "node", "left").select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("place"), F.col("to").isNull().alias("done")))
    arrived, going = [state.where("done")], state.where("NOT done")
    left, steps = going.count(), 1
    most = steps + left
    while left and steps < most:
        ahead = reduce(DataFrame.unionByName, [*arrived, going]).select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("place").alias("_place"), F.col("done").alias("_done"))
        few = F.broadcast if left <= FEW else lambda df: df  # counted
        moved = checkpointed(few(going).join(ahead, "to").select("node", F.col("_to").alias("to"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done")))
        arrived, going = [*arrived, moved.where("done")], moved.where("NOT done")
        left, steps = going.count(), steps * 2
        most = min(most, steps + left)
    state = reduce(DataFrame.unionByName, [*arrived, going])
    return state.select("node", F.when(F.col("done"), F.col("to")).alias("chain"), F.when(F.col("done"), F.col("place")).alias("place"), (~F.col("done")).alias("cyclic"))


def latest_keys(renames: DataFrame) -> DataFrame:
    """(old_key, new_key, steps) of renames(old_key, new_key) made one after another: where each key ends up after
    all of them. Keys on a cycle keep themselves, with null steps. Of several new names of a key the least holds."""
    found = chains(renames.select(F.col("new_key").alias("source"), F.col("old_key").alias("target")))
    return found.where("place > 0 OR cyclic").select(F.col("node").alias("old_key"), F.coalesce("chain", "node").alias("new_key"), F.col("place").alias("steps"))
