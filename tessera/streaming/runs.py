"""The states of extraction runs, kept over a stream of commands, and the same over a whole table.

commands(run_id, at, seq, kind, error): trigger makes a pending run, start sets it running, result ends it (failed
if there is an error), cancel fails a pending or running one, retry queues a pending one again and starts a failed
one anew. What a run's state does not allow is refused and counted. A run that has been running for longer than
LIMIT seconds has failed by then, whatever comes after. Commands of a run take effect in the order of (at, seq).

The stream keeps one state a run, with timers on the watermark: one ends a run at its limit, one drops a finished
run KEEP seconds after its last change. A batch may run again: state and timers are those of the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, KEEP = 300, 86_400
MOST_ERROR = 2000
STATE = "status string, attempt int, started bigint, changed bigint, cancelled boolean, error string, refused int"
FIELDS = [f.split(" ")[0] for f in STATE.split(", ")]
RESULT = f"run_id string, {STATE}"


class Run:
    """The state of one run."""

    def __init__(self, values: tuple | None = None):
        self.status, self.attempt, self.started, self.changed, self.cancelled, self.error, self.refused = values or (None, None, None, None, None, None, 0)

    def values(self) -> tuple:
        return self.status, self.attempt, self.started, self.changed, self.cancelled, self.error, self.refused

    def reach(self, now: int, limit: int) -> None:
        """What the limit does by then."""
        if self.status == "running" and now > self.started + limit:
            self.status, self.changed, self.error = "failed", self.started + limit, "timeout"

    def take(self, at: int, kind: str, error: str | None, limit: int) -> None:
        self.reach(at, limit)
        match kind, self.status:
            case "trigger", None:
                self.status, self.attempt, self.cancelled = "pending", 1, False
            case "start", "pending":
                self.status, self.started = "running", at
            case "result", "running":
                self.status, self.error = ("success", None) if error is None else ("failed", error[:MOST_ERROR])
            case "cancel", "pending" | "running":
                self.status, self.cancelled = "failed", True
            case "retry", "pending":
                pass
            case "retry", "failed":
                self.status, self.attempt, self.started, self.cancelled, self.error = "pending", self.attempt + 1, None, False, None
            case _:
                self.refused += 1
                return
        self.changed = at


def run_states(commands: DataFrame, until: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """(run_id, status, ...) of every run after all its commands; with `until` (a time), also what the limit has
    ended by then. Times are milliseconds. Commands are sorted by Spark and streamed through the tasks: a run
    may have any number of them."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    rows = commands.select("run_id", ms(F.col("at")).alias("at"), F.col("seq").cast("bigint").alias("seq"), "kind", "error")
    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "at", "seq", "kind", "error")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run = None, None
        for b in it:
            out = []
            for run_id, at, _, kind, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run is None or run_id != key:
                    if run is not None:
                        out.append((key, *run.values()))
                    key, run = run_id, Run()
                run.take(at, kind, error, limit * 1000)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if run is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (key, *run.values()), strict=True))], schema)

    schema = pa.schema([("run_id", pa.string()), ("status", pa.string()), ("attempt", pa.int32()), ("started", pa.int64()), ("changed", pa.int64()), ("cancelled", pa.bool_()), ("error", pa.string()), ("refused", pa.int32())])
    s = ordered.mapInArrow(batches, RESULT)
    if until is None:
        return s
    over = (F.col("status") == "running") & (ms(until) > F.col("started") + limit * 1000)
    return s.withColumns({"status": F.when(over, "failed").otherwise(F.col("status")), "changed": F.when(over, F.col("started") + limit * 1000).otherwise(F.col("changed")), "error": F.when(over, "timeout").otherwise(F.col("error"))})


class RunMachine(StatefulProcessor):
    """The same for one run of a stream."""

    def __init__(self, limit: int = LIMIT, keep: int = KEEP):
        self.limit, self.keep = limit * 1000, keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("run", STATE)

    def _run(self) -> Run:
        return Run(tuple(self.held.get()) if self.held.exists() else None)

    def _kept(self, key: tuple, run: Run) -> pd.DataFrame:
        self.held.update(run.values())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if run.status == "running":
            self.handle.registerTimer(run.started + self.limit + 1)
        elif run.status in ("success", "failed"):
            self.handle.registerTimer(run.changed + self.keep)
        return pd.DataFrame([[key[0], *run.values()]], columns=["run_id", *FIELDS]).astype({"attempt": "Int32", "started": "Int64", "changed": "Int64", "cancelled": "boolean", "refused": "Int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, every = self._run(), pd.concat(rows)
        every["at"] = every["at"].astype("datetime64[ms]").astype("int64")
        for r in every.sort_values(["at", "seq", "kind", "error"]).itertuples(index=False):
            run.take(int(r.at), r.kind, None if pd.isna(r.error) else r.error, self.limit)
        yield self._kept(key, run)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, now = self._run(), expiredTimerInfo.getExpiryTimeInMs()
        if run.status == "running":
            run.reach(now, self.limit)
            yield self._kept(key, run)
        elif run.status in ("success", "failed") and now >= run.changed + self.keep:
            self.held.clear()

    def close(self) -> None:
        pass


def run_stream(commands: DataFrame, late: str = "1 minute", limit: int = LIMIT, keep: int = KEEP) -> DataFrame:
    """A stream of the states of runs, a row whenever one changes. The session's state store must be RocksDB's
    (spark.sql.streaming.stateStore.providerClass)."""
    rows = commands.select("run_id", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("bigint").alias("seq"), "kind", "error").withWatermark("at", late)
    return rows.groupBy("run_id").transformWithStateInPandas(RunMachine(limit, keep), RESULT, "Update", "eventTime")
