"""Windows over an event stream, and deduplicated ingest of documents (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.upsert import upsert


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """Count and value of each type and window; with `late`, a watermark for streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Sessions of each user: their start, end and number of events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def new_documents(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of documents, each content once within the watermark."""
    return stream.withColumn("sha256", F.sha2("text", 256)).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["sha256"])


def upsert_into(path: str, keys: list[str], order: tuple[str, ...] = ()):
    """For foreachBatch: merges a batch into versions under path, one folder a batch, so that a batch
    that runs twice writes the same version again. Of a batch's rows of one key the last by `order`
    counts, and by all their columns where that leaves a choice."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={number - 1}"
        rest = [c for c in batch.columns if c not in keys]
        rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("r")).select(*keys, "r.*") if rest else batch.distinct()
        state = rows if number == 0 else upsert(spark.read.parquet(before), rows, keys)
        state.write.mode("overwrite").parquet(f"{path}/v={number}")

    return apply
