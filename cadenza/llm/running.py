"""Running sums over a table that is dealt out by ranges, so that no key has to fit in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _sums(keys: np.ndarray, values: np.ndarray, before: dict[int, int]) -> np.ndarray:
    """Running sums (64 bits, wrapping) of rows sorted by key; before: what a key has already."""
    total = np.cumsum(values.astype(np.uint64))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    base = np.r_[np.uint64(0), total[:-1]][first]
    has = np.array([before.get(k, 0) % 2**64 for k in keys[first].tolist()], np.uint64) if before else np.uint64(0)
    return (total + np.repeat(has - base, np.diff(np.r_[first, len(keys)]))).view(np.int64)


def running(df: DataFrame, key: str, order: list, values: list[str], name: str) -> DataFrame:
    """df with each of `values` (long, not null) as the sum of the key's rows up to this one, in the given order; sums wrap at 64 bits.

    Rows are dealt out by ranges of (key, order), so the rows of one key may lie in many
    partitions. Each task sums its own; what a key brings over a boundary is a row for each
    partition, which is all that the driver gets. key is a long without nulls.
    """
    spark, schema = df.sparkSession, df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, have, seen = TaskContext.get().partitionId(), {v: {} for v in values}, 0
        for b in batches:
            keys = np.asarray(b.column(key))
            if not len(keys):
                continue
            out = dict(zip(b.schema.names, b.columns, strict=True))
            for v in values:
                sums = _sums(keys, np.asarray(b.column(v)), have[v])
                have[v] = {int(keys[-1]): int(sums[-1])}
                out[v] = pa.array(sums)
            yield pa.RecordBatch.from_pydict(out | {"__range": pa.array(np.full(len(keys), part, np.int32)), "__nth": pa.array(np.arange(seen, seen + len(keys)))})
            seen += len(keys)

    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    table = stored(dealt.mapInArrow(local, f"{fields}, `__range` int, `__nth` long"), name)
    ends = table.groupBy("__range").agg(F.min(key).alias("a"), F.max(key).alias("z"))
    over = ends.select("__range", F.explode(F.array_distinct(F.array("a", "z"))).alias(key))
    shared = over.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    # a key's last row in a partition has its whole sum
    rows = table.join(F.broadcast(shared), key).groupBy(key, "__range").agg(*[F.max_by(v, "__nth").alias(v) for v in values]).collect()
    before: dict[str, dict[tuple[int, int], int]] = {v: {} for v in values}
    for v in values:
        have: dict[int, int] = {}
        for r in sorted(rows, key=lambda r: (r[key], r["__range"])):
            before[v][r["__range"], r[key]] = have.get(r[key], 0)
            have[r[key]] = have.get(r[key], 0) + r[v]
    before = {v: {k: x for k, x in d.items() if x % 2**64} for v, d in before.items()}
    if not any(before.values()):
        return table.select(*schema.names)
    carried = spark.sparkContext.broadcast(before)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = dict(zip(b.schema.names, b.columns, strict=True))
            places = list(zip(b.column("__range").to_pylist(), b.column(key).to_pylist(), strict=True))
            for v, known in carried.value.items():
                more = np.array([known.get(p, 0) % 2**64 for p in places], np.uint64)
                out[v] = pa.array((np.asarray(b.column(v)).view(np.uint64) + more).view(np.int64))
            yield pa.RecordBatch.from_pydict({n: out[n] for n in schema.names})

    return table.mapInArrow(add, fields)
