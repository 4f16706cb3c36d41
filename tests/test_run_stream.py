import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import runs as R

SCHEMA = "run_id string, at timestamp, seq int, kind string, error string"
START = dt.datetime(2024, 1, 1)


def commands(rnd):
    rows = []
    for k in range(40):
        t = rnd.randrange(3000)
        for seq in range(rnd.randrange(1, 9)):
            kind = "trigger" if seq == 0 and k % 7 else rnd.choice(["start", "start", "result", "cancel", "retry", "trigger"])
            rows.append((f"r{k}", START + dt.timedelta(seconds=t), seq, kind, rnd.choice([None, None, "broken" * 500]) if kind == "result" else None))
            t += rnd.choice([0, 10, 200, 400])
    return sorted(rows, key=lambda r: r[1])


def by_hand(rows, until):
    """The same machine, written once more: what each run is after all its commands."""
    out = {}
    for run in {r[0] for r in rows}:
        status = started = error = None
        attempt, cancelled, refused = None, None, 0
        for _, at, seq, kind, err in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            if status == "running" and (at - started).total_seconds() > R.LIMIT:
                status, error = "failed", "timeout"
            ok = {"trigger": [None], "start": ["pending"], "result": ["running"], "cancel": ["pending", "running"], "retry": ["pending", "failed"]}[kind]
            if status not in ok:
                refused += 1
            elif kind == "trigger":
                status, attempt, cancelled = "pending", 1, False
            elif kind == "start":
                status, started = "running", at
            elif kind == "result":
                status, error = ("failed", err[: R.MOST_ERROR]) if err else ("success", None)
            elif kind == "cancel":
                status, cancelled = "failed", True
            elif status == "failed":
                status, attempt, cancelled, error = "pending", attempt + 1, False, None
        if status == "running" and (until - started).total_seconds() > R.LIMIT:
            status, error = "failed", "timeout"
        out[run] = (status, attempt, cancelled, error, refused)
    return out


def shown(r):
    return r.status, r.attempt, r.cancelled, r.error, r.refused


def test_batch_states(spark):
    rows = commands(random.Random(1))
    until = START + dt.timedelta(hours=3)
    got = R.run_states(spark.createDataFrame(rows, SCHEMA).repartition(3), F.lit(until))
    assert {r.run_id: shown(r) for r in got.collect()} == by_hand(rows, until)
    assert R.run_states(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("keep", [86_400, 1])
def test_stream_with_a_restart_gives_the_batch_states(spark, tmp_path, keep):
    rows = commands(random.Random(2))
    last = START + dt.timedelta(hours=3)
    parts = [rows[:60], rows[60:120], rows[120:], [("clock", last, 0, "trigger", None)], [("clock", last + dt.timedelta(seconds=1), 1, "cancel", None)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen, dropped = {}, []

    def collect(batch, number):
        for r in batch.collect():
            seen[r.run_id] = shown(r)

    def go():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = R.run_stream(source, late="1 second", keep=keep).writeStream.foreachBatch(collect).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped.append(q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress and q.lastProgress.stateOperators else None)

    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
            if k in (1, 4):  # the query stops after two files and goes on from its checkpoint
                go()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = by_hand(rows, last)
    seen.pop("clock")
    if keep > 1:
        assert seen == want
    else:
        assert {r: s for r, s in seen.items() if s[0] != "failed" or s[3] == "timeout"} != {} and dropped[-1] < len(want)
