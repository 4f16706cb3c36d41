"""Where intermediate tables go, and how the queries load their inputs."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 2 << 20
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see: spark.checkpoint.dir, or else the one that
    setCheckpointDir has set. A session that names none gets a temporary folder only if its master
    is this one process, as in tests; on a cluster that is an error, as executors would not share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: lineage ends there,
    so a lost executor costs its running tasks and nothing that came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if scopes := getattr(_OPEN, "scopes", None):
        scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The written table of what make() returns. Tables that were written on the way there go once
    it is committed, or when it fails: nothing reads them any more."""
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    _OPEN.scopes.append([])
    try:
        df = make()
    except BaseException:
        drop(spark, _OPEN.scopes.pop())
        raise
    own = _OPEN.scopes.pop()
    try:
        return written(df, name)
    finally:
        drop(spark, own)


def if_small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast only if its rows are counted and
    found to be few; otherwise the join that it enters is shuffled."""
    return F.broadcast(table) if table.count() * 8 * len(table.columns) <= BROADCAST_BYTES else table


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables with their folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Python workers on this machine find the package where this file is;
    on a cluster it is installed or shipped like any other."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text, ...) with null text as empty; other columns go, so none can clash."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
