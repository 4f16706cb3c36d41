"""Aggregates that are kept by what changes, not computed anew: counts, sums, distinct values, leaders.

A change is a row with a sign: +1 for one that has come, -1 for one that has gone; an upsert is both. Changes are
aggregated first, so what meets the kept state is a row for each group or value that changed, however often.

counts(group, n, total)      rows and their sum; a group without rows goes
values(group, value, n)      how often each value stands: distinct values are its rows, and so survive deletion
leaders(group, value, n)     the `top + spare` most frequent values of each group, and below, the most that any
                             other value of the group can have

A batch moves leaders by the values it changed alone. Where a group's spare is used up, so that a value that is
not kept could have overtaken the last of its top, that group's leaders are drawn from its values again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import all_checkpointed


def changes(old: DataFrame | None, new: DataFrame | None, keys: list[str], before: DataFrame | None = None) -> DataFrame:
    """Signed rows of one batch: `old` rows go, `new` rows come. With `before`, the table as it was, old and new
    name rows by key: a new row replaces the one that has its key, an old one need hold keys only."""
    parts = []
    if before is not None:
        named = [df.select(*keys) for df in (old, new) if df is not None]
        gone = named[0] if len(named) == 1 else named[0].unionByName(named[1])
        parts.append(before.join(gone.distinct(), keys, "left_semi").withColumn("sign", F.lit(-1)))
    elif old is not None:
        parts.append(old.withColumn("sign", F.lit(-1)))
    if new is not None:
        parts.append(new.withColumn("sign", F.lit(1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Aggregates:
    """The kept state of one view: rows grouped by `group`, an optional summed column, a counted value."""

    group: tuple[str, ...]
    value: str
    summed: str | None
    top: int
    spare: int
    counts: DataFrame
    values: DataFrame
    leaders: DataFrame

    @staticmethod
    def of(rows: DataFrame, group: tuple[str, ...], value: str, summed: str | None = None, top: int = 10, spare: int = 10) -> Aggregates:
        """The state of a whole table."""
        counts, values = _delta(rows.withColumn("sign", F.lit(1)), group, value, summed)
        state = Aggregates(group, value, summed, top, spare, counts, values, values)
        return replace(state, leaders=state._drawn(values))

    def _drawn(self, values: DataFrame) -> DataFrame:
        """Leaders of whole groups: (group, value, n, place, rest), rest being the count of the best value left out."""
        w = Window.partitionBy(*self.group).orderBy(F.desc("n"), self.value)
        keep = self.top + self.spare
        ranked = values.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep + 1)
        rest = F.max(F.when(F.col("place") == keep + 1, F.col("n"))).over(Window.partitionBy(*self.group))
        return ranked.withColumn("rest", F.coalesce(rest, F.lit(0).cast("bigint"))).where(F.col("place") <= keep).drop("place")

    def applied(self, signed: DataFrame) -> Aggregates:
        """The state after a batch of signed rows, cut from its lineage."""
        g = list(self.group)
        counts, values = _delta(signed, self.group, self.value, self.summed)
        cut = all_checkpointed({"values": _added(self.values, values, [*g, self.value], ["n"]), "delta": values})
        touched = cut["delta"].select(*g, self.value)
        # what the batch changed, with its new counts, and the leaders that it left alone
        moved = touched.join(cut["values"], [*g, self.value])
        rest = self.leaders.groupBy(*g).agg(F.max("rest").alias("rest"))
        stay = self.leaders.join(touched, [*g, self.value], "left_anti").select(*g, self.value, "n")
        both = stay.unionByName(moved.select(*g, self.value, "n")).join(rest, g, "left").withColumn("rest", F.coalesce("rest", F.lit(0).cast("bigint")))
        w = Window.partitionBy(*g).orderBy(F.desc("n"), self.value)
        keep = self.top + self.spare
        ranked = both.withColumn("place", F.row_number().over(w))
        # a value left out has `rest` at most, then or now: those above it are in place for certain
        sure = ranked.groupBy(*g).agg(F.count_if(F.col("n") > F.col("rest")).alias("sure"), F.max("rest").alias("rest"), F.max(F.when(F.col("place") == keep + 1, F.col("n"))).alias("out"))
        known = F.col("sure").between(self.top, keep) | (F.col("sure") > keep) | (F.col("rest") == 0)
        kept = ranked.drop("rest").join(sure, g).where(known & (F.col("place") <= F.when(F.col("rest") == 0, keep).otherwise(F.least("sure", F.lit(keep)))))
        kept = kept.select(*g, self.value, "n", F.greatest("rest", F.coalesce("out", F.lit(0).cast("bigint"))).alias("rest"))
        again = sure.where(~known).select(*g)
        untouched = self.leaders.join(touched.select(*g).distinct(), g, "left_anti").select(*g, self.value, "n", "rest")
        changed = kept.join(touched.select(*g).distinct(), g, "left_semi")
        drawn = self._drawn(cut["values"].join(again, g, "left_semi")).select(*g, self.value, "n", "rest")
        new = all_checkpointed({"counts": _added(self.counts, counts, g, ["n", "total"]), "leaders": untouched.unionByName(changed).unionByName(drawn)})
        return replace(self, counts=new["counts"], values=cut["values"], leaders=new["leaders"])

    def distinct(self) -> DataFrame:
        """(group, values): how many distinct values each group has."""
        return self.values.groupBy(*self.group).agg(F.count(F.lit(1)).alias("values"))

    def best(self) -> DataFrame:
        """(group, value, n, rank): the `top` most frequent values of each group."""
        w = Window.partitionBy(*self.group).orderBy(F.desc("n"), self.value)
        return self.leaders.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.top).drop("rest")


def _delta(signed: DataFrame, group: tuple[str, ...], value: str, summed: str | None) -> tuple[DataFrame, DataFrame]:
    total = F.sum(F.col("sign") * F.col(summed)) if summed else F.lit(None).cast("bigint")
    counts = signed.groupBy(*group).agg(F.sum("sign").alias("n"), total.alias("total"))
    values = signed.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum("sign").alias("n"))
    return counts, values


def _added(state: DataFrame, delta: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    both = state.select(*keys, *numbers).unionByName(delta.select(*keys, *numbers))
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in numbers)).where("n <> 0")
