"""What held when: states joined as of many times, intervals from histories, edges with a validity.

Rows as of a time are found by union and fill, not by comparing each time with each state: both sides stand in one
order of time, and a state is carried on to the times behind it. A key's time line is cut into buckets, which are
filled side by side; the last state before each bucket is carried over from the buckets before. So a key that holds
a third of all rows is the work of as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(c: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)


def as_of(times: DataFrame, states: DataFrame, key: str, at: str, since: str, until: str | None = None, order: str | None = None, bucket: int = 86_400) -> DataFrame:
    """times with the state of `key` that began last at or before `at`: the columns of states but its key, null
    where there is none. With `until`, a state that had ended by then (until <= at) is none. Of states that begin
    together the last by `order` counts, else the largest. Null times and null keys have no state."""
    rest = [c for c in states.columns if c != key]
    told = F.struct(*(F.col(c) for c in rest))
    place = F.struct(F.col(since).alias("_t"), *([F.col(order).alias("_o")] if order else []), told.alias("_s"))
    s = states.where(F.col(since).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), _bucket(F.col(since), bucket).alias("_b"), place.alias("_p"))
    t = times.withColumn("_k", F.col(key)).withColumn("_b", _bucket(F.col(at), bucket))
    ends = s.groupBy("_k", "_b").agg(F.max("_p").alias("_last"))
    # one row for each bucket that either side has: what the buckets before it leave behind
    marks = ends.unionByName(t.select("_k", "_b").where("_b IS NOT NULL").distinct(), allowMissingColumns=True).groupBy("_k", "_b").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_k", "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    both = t.select("_k", "_b", F.col(at).alias("_t"), F.lit(1).alias("_asks"), F.struct(*(F.col(c) for c in times.columns)).alias("_row")).unionByName(
        s.select("_k", "_b", F.col("_p._t").alias("_t"), F.lit(0).alias("_asks"), "_p"), allowMissingColumns=True
    )
    behind = Window.partitionBy("_k", "_b").orderBy("_t", "_asks", "_p").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_found", F.last("_p", ignorenulls=True).over(behind)).where("_asks = 1").select("_k", "_b", "_row", "_found")
    met = filled.join(carried, ["_k", "_b"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    held = F.col("_found._s")
    alive = F.col(f"_row.{at}").isNotNull() if until is None else F.col(f"_row.{at}").isNotNull() & (held[until].isNull() | (held[until] > F.col(f"_row.{at}")))
    return met.select("_row.*", *(F.when(alive, held[c]).alias(c if c not in times.columns else f"state_{c}") for c in rest))


def intervals(history: DataFrame, key: str, since: str, order: str | None = None) -> DataFrame:
    """history with valid_from and valid_to: each row of a key holds until the next one begins, the last for good."""
    w = Window.partitionBy(key).orderBy(since, *([order] if order else []))
    return history.withColumn("valid_from", F.col(since)).withColumn("valid_to", F.lead(since).over(w))


def holding(edges: DataFrame, at: Column, confirmed: bool = False) -> DataFrame:
    """Edges(valid_from, valid_to, ...) that hold at a time: begun, not ended; open ends hold for good. With
    `confirmed`, only those whose confirmed_at is no later."""
    began = F.col("valid_from").isNull() | (F.col("valid_from") <= at)
    there = began & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return edges.where(there & F.col("confirmed_at").isNotNull() & (F.col("confirmed_at") <= at) if confirmed else there)
