"""A pipeline as a list of DataFrame transforms with a record of each stage."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def run_stages(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], write: Callable[[DataFrame, str], DataFrame], fail_fast: bool = True) -> tuple[DataFrame, list[dict]]:
    """Applies the stages in order; `write` stores a stage's result and returns the stored table. The
    metrics hold each stage's name, start, seconds, rows and error; without fail_fast a stage that
    fails leaves its input as it is."""
    metrics = []
    for name, stage in stages:
        began, seen, error = time.time(), Observation(name), None
        try:
            df = write(stage(df).observe(seen, F.count(F.lit(1)).alias("rows")), name)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:2000]
        metrics.append({"name": name, "start": began, "seconds": time.time() - began, "rows": None if error else seen.get["rows"], "error": error})
        if error and fail_fast:
            raise RuntimeError(f"stage {name} failed: {error}")
    return df, metrics
