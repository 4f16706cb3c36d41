"""Connected components by alternating smallest-neighbour and shortcut steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Each round a vertex takes the smallest label among its own and its neighbours', then the
    label of its label; stars, which the callers mostly give, settle in two or three rounds.
    A vertex with very many neighbours is pre-aggregated before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "id")
        step = labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("of"))
        new = written(step.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("of", "component")).alias("component")), "labels")
        if new.where("was <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
