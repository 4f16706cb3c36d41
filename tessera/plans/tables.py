"""Loading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a part in which reports are dealt
PART_ROWS = 100_000
#: a table of up to so many bytes, counted first, is broadcast
SENT_BYTES = 8 << 20
#: setting of a session whose tables are dealt by report: the number of parts
DEALT = "spark.tessera.dealt"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(spark: SparkSession) -> SparkSession:
    """A session of the same context and settings whose joins on several keys, one of which rows are dealt by
    (see dealt), find them where they are; Spark by itself deals both sides again by all keys."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # the sorted files of kept() are not sorted again
    own.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # they are read as dealt under unions too
    own.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # the JVM never compiles a longer method; rules on names make such
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a compressed file's size says little of its rows: see sent()
    return own


def dealt(frames: dict[str, tuple[DataFrame, str]], often: bool = False) -> dict[str, DataFrame]:
    """The tables, each dealt by its column into one number of parts that grows with their rows, so that a part's
    sorts stay small: what is grouped by that column, or joined on it, is not shuffled again. Tables that are read
    often, each time by other columns, are kept so, and from then on their session deals into as many parts."""
    spark = next(iter(frames.values()))[0].sparkSession
    rows = sum(df.count() for df, _ in frames.values())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    if not often:
        return {name: df.repartition(parts, column) for name, (df, column) in frames.items()}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set(DEALT, parts)
    return {name: kept(df.repartition(parts, column), column, parts) for name, (df, column) in frames.items()}


def sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its texts and rows, which are counted first, take SENT_BYTES at most: what it is joined
    with then stays where it is dealt. A larger table is joined as it is."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(64)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= SENT_BYTES else df


def python_path(spark: SparkSession) -> None:
    """Lets Python workers on this machine find the package where this file is; on a cluster it is installed
    or shipped like any other."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def _folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder: that of setCheckpointDir, or of spark.checkpoint.dir. A session that names
    none gets a temporary folder only if its master is this one process, as in tests; on a cluster that is an
    error, as executors would not share it."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the checkpoint folder: smaller than a checkpoint, which keeps whole rows as they
    are in memory, and read by column."""
    spark = df.sparkSession
    _folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, column: str, parts: int) -> DataFrame:
    """df, dealt by the column into `parts`, as a compressed table in the checkpoint folder that is read as it is dealt
    and sorted: one bucket a part. The catalog forgets its name at once."""
    spark = df.sparkSession
    _folder(spark)
    name = f"tessera_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.write.bucketBy(parts, column).sortBy(column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: its files stay
    return out


def all_checkpointed(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames from reliable checkpoints, or kept where the session deals by report, written side by side; one without rows is known to have none, so that
    the optimizer drops what is joined or united with it."""
    if not frames:
        return {}
    _folder(next(iter(frames.values())).sparkSession)

    def written(df: DataFrame) -> DataFrame:
        parts = df.sparkSession.conf.get(DEALT, "")
        out = kept(df, "doc", int(parts)) if parts else df.checkpoint()
        return out.where(F.lit(False)) if out.isEmpty() else out

    with ThreadPoolExecutor(min(8, len(frames))) as pool:
        return dict(zip(frames, pool.map(written, frames.values()), strict=True))
