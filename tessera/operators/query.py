"""Structured queries, keyword search and record lists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


@dataclass(frozen=True)
class Entity:
    """What structured queries know of a record type: its key, time and equality fields."""

    key: str
    times: tuple[str, ...]
    equals: tuple[str, ...]
    updated: str | None = None


def conditions(entity: Entity, filters: dict[str, object]) -> list[Column]:
    """Filters of the entity as predicates; those of other entities and empty ones are ignored. Times that are
    texts are read as such; a text that is no time is in no range."""
    out = []
    for f in entity.times:
        low, high = filters.get(f"{f}_from"), filters.get(f"{f}_to")
        if low:
            out.append(F.col(f).try_cast("timestamp_ntz") >= F.lit(low).cast("timestamp_ntz"))
        if high:
            out.append(F.col(f).try_cast("timestamp_ntz") <= F.lit(high).cast("timestamp_ntz"))
    return out + [F.col(f) == F.lit(filters[f]) for f in entity.equals if filters.get(f) not in (None, "")]


def structured(df: DataFrame, entity: Entity, filters: dict[str, object], sort_by: str | None = None, descending: bool = True, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page in a total order: the sort field (null counts as the largest value), then the
    update time of the entity, latest first, then the key."""
    if page_size < 1 or page_size > 100:
        raise ValueError("page_size must be 1 to 100")
    field = sort_by or entity.times[0]
    by = F.col(field).try_cast("timestamp_ntz") if field in entity.times else F.col(field)
    order = by.desc_nulls_first() if descending else by.asc_nulls_last()
    return matching(df, entity, filters).orderBy(order, *([F.col(entity.updated).desc_nulls_first()] if entity.updated else []), entity.key).offset(max(page - 1, 0) * page_size).limit(page_size)


def matching(df: DataFrame, entity: Entity, filters: dict[str, object]) -> DataFrame:
    for c in conditions(entity, filters):
        df = df.where(c)
    return df


def runs_page(runs: DataFrame, documents: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of runs(run_id, document_id, started_at, ...), newest first, each with its document's file_name,
    where there is one. The page is cut before the join: documents(document_id, file_name) hold an id once."""
    if page_size < 1 or page_size > 200:
        raise ValueError("page_size must be 1 to 200")
    order = [F.col("started_at").desc_nulls_last(), F.col("run_id")]
    cut = runs.orderBy(*order).offset(max(page - 1, 0) * page_size).limit(page_size)
    return documents.select("document_id", "file_name").join(F.broadcast(cut), "document_id", "right").select(*runs.columns, "file_name").orderBy(*order)


def search_chunks(chunks: DataFrame, q: str, limit: int) -> DataFrame:
    """(type, id, content, score): texts like %q% (its wildcards hold). All of them are scored by what is shown of
    them; the best stay, of equals the newest."""
    snippet = F.substring("text", 1, 500)
    hits = chunks.where(F.col("text").ilike(f"%{q}%")).select(F.lit("Chunk").alias("type"), "id", snippet.alias("content"), T.score(snippet, T.tokenize(F.lit(q))).alias("score"), "at")
    return hits.orderBy(F.desc("score"), F.col("at").desc_nulls_first(), "id").limit(limit).drop("at")


def search_entities(nodes: DataFrame, q: str, keys: list[str]) -> DataFrame:
    """(type, id, content, score): nodes with any property that contains the whole query."""
    hits = nodes.where(T.any_property_contains(F.col("props"), q.strip()))
    content = F.coalesce(F.nullif(T.best_content(F.col("props"), keys), F.lit("")), F.col("business_key"))
    return hits.select(F.col("label").alias("type"), F.col("business_key").alias("id"), content.alias("content")).withColumn("score", T.score(F.col("content"), T.tokenize(F.lit(q))))


def merged(entities: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """Both results by score, each (type, id) once; top_k is held to 1 .. 50."""
    both = entities.unionByName(chunks).where("id IS NOT NULL AND id <> ''")
    best = both.groupBy("type", "id").agg(F.max_by(F.struct("content", "score"), F.struct("score", "content")).alias("b")).select("type", "id", "b.content", "b.score")
    return best.orderBy(F.desc("score"), "type", "id").limit(min(max(top_k, 1), 50))


def of_type(results: DataFrame, selected: str | None) -> DataFrame:
    """Search results of the selected type; all of them where none is selected."""
    return results.where(F.col("type") == selected) if selected else results


# What a summary shows of each type.
SUMMARY_KEYS = {
    "EightDReport": ["business_key", "report_no", "issue_title", "report_date", "closed_at", "report_status", "owner_name", "confidence", "source_doc_id"],
    "ProductEvent": ["business_key", "event_id", "event_code", "event_type", "occurred_at", "severity", "symptom", "confidence", "source_doc_id"],
    "ActionItem": ["business_key", "action_id", "title", "action_type", "status", "owner_name", "due_date", "completed_at", "confidence", "source_doc_id"],
}
OTHER_KEYS = ["business_key", "confidence", "source_doc_id"]


def type_summary(label: Column, props: Column) -> Column:
    """The properties that a summary of the type shows, without those that are null, as a map in fixed order."""

    def shown(keys: list[str]) -> Column:
        names = F.array(*map(F.lit, keys))
        return F.map_from_arrays(F.filter(names, lambda k: F.try_element_at(props, k).isNotNull()), F.array_compact(F.transform(names, lambda k: F.try_element_at(props, k))))

    out = F.when(F.lit(False), shown(OTHER_KEYS))
    for kind, keys in SUMMARY_KEYS.items():
        out = out.when(label == kind, shown(keys))
    return out.otherwise(shown(OTHER_KEYS))
