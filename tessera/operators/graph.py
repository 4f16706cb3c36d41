"""A typed property graph as two DataFrames and its read operators.

nodes(label, business_key, title, props, created_at, updated_at)
edges(from_label, from_key, rel_type, to_label, to_key, created_at, updated_at)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.temporal import holding
from tessera.operators.upsert import detach_delete
from tessera.plans.tables import checkpointed

MAX_DEPTH = 4
#: A frontier of up to so many node keys (a few MB) is broadcast.
FRONTIER = 50_000
NODE_KEY = ["label", "business_key"]
EDGE_KEY = ["from_label", "from_key", "rel_type", "to_label", "to_key"]


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def with_label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def business_edges(self, exclude: tuple[str, ...] = ()) -> DataFrame:
        """Edges with neither end under an excluded label."""
        if not exclude:
            return self.edges
        return self.edges.where(~F.col("from_label").isin(*exclude) & ~F.col("to_label").isin(*exclude))

    def edge_ends(self) -> DataFrame:
        """Edges joined with the titles of both ends; an edge without a node at an end goes."""
        a = self.nodes.select(F.col("label").alias("from_label"), F.col("business_key").alias("from_key"), F.col("title").alias("from_title"))
        b = self.nodes.select(F.col("label").alias("to_label"), F.col("business_key").alias("to_key"), F.col("title").alias("to_title"))
        return self.edges.join(a, ["from_label", "from_key"]).join(b, ["to_label", "to_key"])

    def symmetric(self) -> DataFrame:
        """(label, business_key, to_label, to_key): every edge in both directions."""
        e = self.edges.select(F.col("from_label").alias("label"), F.col("from_key").alias("business_key"), "to_label", "to_key")
        return e.unionByName(e.select(F.col("to_label").alias("label"), F.col("to_key").alias("business_key"), F.col("label").alias("to_label"), F.col("business_key").alias("to_key")))

    def neighbourhood(self, label: str, key: str, depth: int) -> DataFrame:
        """(label, business_key, distance) of the nodes within depth undirected steps of the centre;
        empty if there is no such node. Each step expands only the nodes reached last."""
        return self.around(self.nodes.where((F.col("label") == label) & (F.col("business_key") == key)), depth)

    def around(self, roots: DataFrame, depth: int) -> DataFrame:
        """(label, business_key, distance) of the nodes within depth undirected steps of any root. A
        frontier of at most FRONTIER nodes, which is counted first, is broadcast to the scans of the
        edges, so that these are not shuffled; a larger one is joined."""
        if not 0 <= depth <= MAX_DEPTH:
            raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
        reached = roots.select(*NODE_KEY).distinct().withColumn("distance", F.lit(0))
        links = self.symmetric()
        for k in range(1, depth + 1):
            last = reached.where(F.col("distance") == k - 1).select(*NODE_KEY)
            few = last.limit(FRONTIER + 1).count() <= FRONTIER
            met = links.join(F.broadcast(last) if few else last, NODE_KEY, "left_semi").select(F.col("to_label").alias("label"), F.col("to_key").alias("business_key")).distinct()
            reached = reached.unionByName(met.join(reached, NODE_KEY, "left_anti").withColumn("distance", F.lit(k)))
            if k < depth:
                reached = checkpointed(reached)
        return reached

    def induced(self, keys: DataFrame) -> DataFrame:
        """Edges with both ends among the nodes `keys`."""
        a = keys.select(F.col("label").alias("from_label"), F.col("business_key").alias("from_key"))
        b = keys.select(F.col("label").alias("to_label"), F.col("business_key").alias("to_key"))
        return self.edges.join(a, ["from_label", "from_key"], "left_semi").join(b, ["to_label", "to_key"], "left_semi")

    def subgraph(self, label: str, key: str, depth: int, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """Nodes and induced edges within depth. Excluded labels go after the traversal, so what is
        reached only through them stays."""
        near = self.neighbourhood(label, key, depth)
        kept = near.where(~F.col("label").isin(*exclude)) if exclude else near
        return kept, self.induced(kept)

    def latest(self, limit: int, exclude: tuple[str, ...] = ()) -> DataFrame:
        """The latest edges by update time, else creation time."""
        if not 1 <= limit <= 5000:
            raise ValueError("limit must be 1 to 5000")
        return self.business_edges(exclude).withColumn("at", F.coalesce("updated_at", "created_at")).orderBy(F.col("at").desc_nulls_first(), *EDGE_KEY).limit(limit)

    def latest_graph(self, limit: int, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): the latest edges and every node that has the key of one of their ends,
        whatever its label."""
        e = self.latest(limit, exclude)
        ends = e.select(F.explode(F.array("from_key", "to_key")).alias("business_key")).distinct()  # at most 2 * 5000
        return self.nodes.join(F.broadcast(ends), "business_key", "left_semi"), e

    def listing(self, label: str, key: str, rel_types: list[str], then: str) -> DataFrame:
        """(rel_type, business_key, then_key): what the node is linked to by these types and, where
        there is one, what that is linked to by the type `then`; ordered."""
        first = self.edges.where((F.col("from_label") == label) & (F.col("from_key") == key) & F.col("rel_type").isin(rel_types)).select("rel_type", F.col("to_label").alias("label"), F.col("to_key").alias("business_key"))
        second = self.edges.where(F.col("rel_type") == then).select(F.col("from_label").alias("label"), F.col("from_key").alias("business_key"), F.col("to_key").alias("then_key"))
        return first.join(second, NODE_KEY, "left").select("rel_type", "business_key", "then_key").orderBy("business_key", "rel_type", "then_key")

    def without_around(self, roots: DataFrame, depth: int = 2, across: bool = False) -> "PropertyGraph":
        """The graph without the nodes within depth of the roots and their edges. Nodes that other
        documents share go too, so it is done only where `across` says so."""
        if not across:
            raise ValueError("nodes shared with other documents would go too: pass across=True")
        return PropertyGraph(*detach_delete(self.nodes, self.edges, self.around(roots, depth).select(*NODE_KEY)))

    def confident(self, label: str, key: str, depth: int, max_nodes: int = 200, min_confidence: float = 0.0, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the best `max_nodes` nodes around a centre: nodes(label, business_key, confidence, hops),
        confidence being the highest product of the edges' (null counts as 1) over paths of at most depth steps, either
        way. Nodes whose own confidence (a column of nodes, if there is one) is below min_confidence, or whose label is
        excluded, are not walked through.

        Every step goes on from the best max_nodes reached so far, by confidence, then hops, then label and key. What
        is cut there cannot be on the way to a better node: no path is better than its beginning."""
        if not 0 <= depth <= MAX_DEPTH or not 1 <= max_nodes <= 5000:
            raise ValueError(f"depth must be 0 to {MAX_DEPTH}, max_nodes 1 to 5000")
        passable = self.nodes.where(~F.col("label").isin(*exclude)) if exclude else self.nodes
        if "confidence" in passable.columns and min_confidence > 0:
            passable = passable.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
        e = self.edges.select(F.col("from_label").alias("label"), F.col("from_key").alias("business_key"), F.col("to_label").alias("_label"), F.col("to_key").alias("_key"), F.coalesce("confidence", F.lit(1.0)).alias("_by"))
        back = e.select(F.col("_label").alias("label"), F.col("_key").alias("business_key"), F.col("label").alias("_label"), F.col("business_key").alias("_key"), "_by")
        links = e.unionByName(back)
        best = checkpointed(passable.where((F.col("label") == label) & (F.col("business_key") == key)).select(*NODE_KEY, F.lit(1.0).alias("confidence"), F.lit(0).alias("hops")))
        for step in range(1, depth + 1):
            front = F.broadcast(best.where(F.col("hops") == step - 1))  # max_nodes rows at most
            met = links.join(front, NODE_KEY).groupBy(F.col("_label").alias("label"), F.col("_key").alias("business_key")).agg(F.max(F.col("confidence") * F.col("_by")).alias("confidence"))
            met = met.join(passable.select(*NODE_KEY), NODE_KEY, "left_semi").withColumn("hops", F.lit(step))
            both = best.unionByName(met).groupBy(*NODE_KEY).agg(F.max(F.struct("confidence", -F.col("hops"))).alias("b"))
            best = both.select(*NODE_KEY, F.col("b.confidence").alias("confidence"), (-F.col("b.col2")).alias("hops"))
            best = checkpointed(best.orderBy(F.desc("confidence"), "hops", *NODE_KEY).limit(max_nodes))
        keys = F.broadcast(best.select(*NODE_KEY))
        return best, self.induced(keys)

    def neighbours(self, label: str, key: str, direction: str = "both", rel_types: list[str] | None = None, depth: int = 1, limit: int = 50) -> DataFrame:
        """(label, business_key, distance) of the nodes one or two steps along edges of these types in a direction
        (in, out or both), nearest first, then by label and key."""
        if direction not in ("in", "out", "both") or depth not in (1, 2) or limit < 1:
            raise ValueError("direction must be in, out or both, depth 1 or 2, limit positive")
        e = self.edges.where(F.col("rel_type").isin(rel_types)) if rel_types else self.edges
        out = e.select(F.col("from_label").alias("label"), F.col("from_key").alias("business_key"), "to_label", "to_key")
        into = e.select(F.col("to_label").alias("label"), F.col("to_key").alias("business_key"), F.col("from_label").alias("to_label"), F.col("from_key").alias("to_key"))
        links = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
        reached = checkpointed(self.nodes.where((F.col("label") == label) & (F.col("business_key") == key)).select(*NODE_KEY).withColumn("distance", F.lit(0)))
        for step in range(1, depth + 1):
            last = reached.where(F.col("distance") == step - 1).select(*NODE_KEY)
            few = last.limit(FRONTIER + 1).count() <= FRONTIER
            met = links.join(F.broadcast(last) if few else last, NODE_KEY, "left_semi").select(F.col("to_label").alias("label"), F.col("to_key").alias("business_key")).distinct()
            reached = checkpointed(reached.unionByName(met.join(reached, NODE_KEY, "left_anti").withColumn("distance", F.lit(step))))
        return reached.where("distance > 0").orderBy("distance", *NODE_KEY).limit(limit)

    def most_confident(self, limit: int) -> DataFrame:
        """A graph's edges cut to the `limit` of highest confidence (a column of edges)."""
        return self.edges.orderBy(F.col("confidence").desc_nulls_last(), *EDGE_KEY).limit(limit)

    def as_of(self, at: Column, confirmed: bool = False) -> "PropertyGraph":
        """The graph with the edges that hold at a time; see temporal.holding. All reads work on it."""
        return PropertyGraph(self.nodes, holding(self.edges, at, confirmed))

    def node_counts(self) -> DataFrame:
        return self.nodes.where("business_key IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))

    def edge_counts(self, exclude: tuple[str, ...] = ()) -> DataFrame:
        return self.business_edges(exclude).groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"))

    def incident(self, label: str, key: str) -> DataFrame:
        """(direction, rel_type, label, business_key) of the edges at a node."""
        out = self.edges.where((F.col("from_label") == label) & (F.col("from_key") == key)).select(F.lit("out").alias("direction"), "rel_type", F.col("to_label").alias("label"), F.col("to_key").alias("business_key"))
        into = self.edges.where((F.col("to_label") == label) & (F.col("to_key") == key) & ~((F.col("from_label") == label) & (F.col("from_key") == key)))
        return out.unionByName(into.select(F.lit("in").alias("direction"), "rel_type", F.col("from_label").alias("label"), F.col("from_key").alias("business_key")))

    def centres(self, label: str, limit: int, exclude: tuple[str, ...] = ()) -> DataFrame:
        """The nodes of a label with the most distinct incident edges; nodes without edges count 0,
        a self-loop counts once."""
        if not 1 <= limit <= 50:
            raise ValueError("limit must be 1 to 50")
        e = self.business_edges(exclude).select(*EDGE_KEY)
        mine = e.where(F.col("from_label") == label).select(F.col("from_key").alias("business_key"))
        other = e.where((F.col("to_label") == label) & ~((F.col("from_label") == label) & (F.col("from_key") == F.col("to_key")))).select(F.col("to_key").alias("business_key"))
        degree = mine.unionByName(other).groupBy("business_key").agg(F.count(F.lit(1)).alias("degree"))
        ranked = self.with_label(label).join(degree, "business_key", "left").select("business_key", F.coalesce("title", "business_key").alias("title"), F.coalesce("degree", F.lit(0)).alias("degree"), "updated_at")
        return ranked.orderBy(F.desc("degree"), F.col("updated_at").desc_nulls_first(), "business_key").limit(limit)

    def explore(self, labels: list[str], rel_types: list[str], keyword: str) -> DataFrame:
        """Edges of these types between nodes of these labels where the keyword is in a key or title."""
        e = self.edge_ends().where(F.col("rel_type").isin(rel_types) & F.col("from_label").isin(labels) & F.col("to_label").isin(labels))
        hit = [F.lower(c).contains(keyword.lower()) for c in ("from_key", "to_key", "from_title", "to_title")]
        return e.where(hit[0] | hit[1] | hit[2] | hit[3])


def descendants(links: DataFrame, roots: DataFrame, most: int = 50) -> DataFrame:
    """(root, node, level) of a hierarchy or chain links(parent, child): everything below each root, the
    root itself at level 0. A node counts once under a root, at its least level, so cycles end. Each
    level starts from a reliable checkpoint; more than `most` levels raise an error."""
    reached = checkpointed(roots.select("root", F.col("root").alias("node")).distinct().withColumn("level", F.lit(0)))
    for level in range(1, most + 1):
        last = reached.where(F.col("level") == level - 1).select("root", F.col("node").alias("parent"))
        new = last.join(links, "parent").select("root", F.col("child").alias("node")).distinct().join(reached, ["root", "node"], "left_anti").withColumn("level", F.lit(level))
        new = checkpointed(new)
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
    raise ValueError(f"more than {most} levels")
