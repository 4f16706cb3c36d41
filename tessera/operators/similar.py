"""Entities merged by their vectors: an approximate similarity join by signs of random projections.

Vectors that are equal count once. Each of `tables` hash tables gives a vector the signs of `bits` random
projections; two vectors at an angle a agree on one with probability 1 - a / pi. Within a bucket vectors are
compared exactly, MOST at a time: parts of a larger bucket are solved on their own, and the representatives of
what they found, one a component, meet in the next round, until a bucket is one part. So no task holds more than
MOST vectors of a bucket, no list of pairs is written, and a group of near copies of any size shrinks to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.operators.ranking import _arrow, _matrix
from tessera.plans.tables import checkpointed

MOST = 1024
TARGET = 64


def tables_for(recall: float, least: float, bits: int) -> int:
    """Tables so that two vectors of cosine `least` share a bucket with probability `recall`."""
    together = (1 - math.acos(least) / math.pi) ** bits
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def grouped(matrix: np.ndarray, least: float) -> np.ndarray:
    """For unit rows, the place of the first row of each one's component under cosines of `least` or more."""
    near = matrix @ matrix.T >= least - 1e-12
    first = np.full(len(matrix), -1)
    for k in range(len(matrix)):
        if first[k] < 0:
            front = np.array([k])
            first[k] = k
            while len(front):
                reached = np.flatnonzero(near[front].any(axis=0) & (first < 0))
                first[reached] = k
                front = reached
    return first


def similar_entities(vectors: DataFrame, least: float = 0.9, recall: float = 0.99, seed: int = 1) -> DataFrame:
    """(id, component, copies) of vectors(id, vector): the smallest id reachable over cosines of `least` or more;
    copies counts rows of the same vector. Null vectors, and such as have no direction, are linked with nothing."""
    rows = vectors.where("id IS NOT NULL").select("id", "vector")
    norm = F.aggregate("vector", F.lit(0.0), lambda t, v: t + v.cast("double") * v)
    told = rows.where(norm > 0)
    one = checkpointed(told.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    n, width = one.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    own = rows.join(one.select("vector", "rep", "copies"), "vector", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    if not n:
        return own.select("id", F.col("rep").alias("component"), "copies")
    bits = max(1, math.ceil(math.log2(max(2, n / TARGET))))
    tables = tables_for(recall, least, bits)
    planes = np.random.RandomState(seed).randn(width, tables * bits)
    kind, arrow = one.schema["rep"].dataType.simpleString(), _arrow(one, "rep")

    def signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (1 << np.arange(bits, dtype=np.int64)) if bits < 63 else None
        for b in it:
            on = (_matrix(b.column(1), width) @ planes >= 0).reshape(b.num_rows, tables, bits)
            sig = on @ power + (np.arange(tables, dtype=np.int64) << bits)[None, :]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(sig), pa.list_(pa.int64()))], ["rep", "buckets"])

    signs = one.select("rep", "vector").mapInArrow(signed, f"rep {kind}, buckets array<bigint>")
    members = checkpointed(signs.select("rep", F.explode("buckets").alias("bucket")))
    schema = pa.schema([("a", arrow), ("b", arrow), ("bucket", pa.int64()), ("round", pa.int32())])

    def solved(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        ids = part.column("rep").to_pylist()
        first = grouped(_matrix(part.column("vector").combine_chunks(), width), least)
        bucket = part.column("bucket")[0].as_py()
        rows = [{"a": ids[f], "b": ids[k], "bucket": bucket, "round": 0} for k, f in enumerate(first.tolist())]
        return pa.Table.from_pylist(rows, schema)

    links, left = None, members
    while True:
        size = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        parts = left.join(size, "bucket").withColumn("part", F.when(F.col("n") > MOST, F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / MOST))).otherwise(F.lit(0)))
        held = parts.join(one.select("rep", "vector"), "rep").select("rep", "vector", "bucket", "part", "n")
        found = checkpointed(held.groupBy("bucket", "part").applyInArrow(solved, f"a {kind}, b {kind}, bucket bigint, round int"))
        new = found.where("a <> b").select("a", "b")
        links = new if links is None else links.unionByName(new)
        large = size.where(F.col("n") > MOST).select("bucket")
        heads = checkpointed(found.where("a = b").join(large, "bucket").select(F.col("a").alias("rep"), "bucket"))
        again = heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(size.withColumnRenamed("n", "before"), "bucket")
        # buckets that no longer shrink hold what is not alike: nothing is left to link there
        go = checkpointed(again.where("n < before").select("bucket"))
        if go.isEmpty():
            break
        left = heads.join(go, "bucket")
    labels = components(links.distinct()).withColumnRenamed("id", "rep")
    return own.join(labels, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"), "copies")
