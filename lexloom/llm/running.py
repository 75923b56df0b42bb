"""Running sums along the rows of a key, where a key may hold any part of all rows.

Rows are range-partitioned by key and order and sorted, so a key's rows lie in order over one or
more tasks. Numpy sums within a task; what a task's first key has before that task is one row a
task, which is chained on the driver (as many rows as there are partitions) and added by a broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, written


def within_runs(keys: np.ndarray, values: np.ndarray, last: int | None, before: int, modulus: int | None) -> np.ndarray:
    """Sums along equal neighbours of `keys`; `before` is the sum so far where the first key is `last`.
    With a modulus (below 2^31) sums are remainders."""
    sums = np.cumsum(values)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(new)
    off = sums[begin] - values[begin]
    if last is not None and keys[0] == last:
        off[0] -= before
    sums = sums - np.repeat(off, np.diff(np.append(begin, len(keys))))
    return sums % modulus if modulus else sums


def running_sums(rows: DataFrame, key: str, order: list[Column], sums: dict[str, int | None], keep: list[str], name: str, ranges: list[Column] | None = None) -> DataFrame:
    """key, the columns of `keep` and, for each entry of `sums` (a long column: its modulus or None), `run_<column>`:
    the sum over the rows of the key up to this one. Keys are longs and not null; `order` decides among
    a key's rows. ranges: what tasks are cut by, where not by the whole order (a coarser order that agrees with it, as
    samples of it go to the driver). The result has been written once before the sums of earlier tasks are added to it."""
    bound_batches(rows.sparkSession)
    placed = rows.repartitionByRange(key, *(ranges or order)).sortWithinPartitions(key, *order).select(key, *keep, *[c for c in sums if c not in keep])
    kept = [placed.schema[c] for c in [key, *keep]]
    fields = [*kept, *(T.StructField(f"run_{c}", T.LongType()) for c in sums), T.StructField("_task", T.IntegerType()), T.StructField("_first", T.BooleanType())]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last, so_far = TaskContext.get().partitionId(), None, None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            first = int(keys[0]) if first is None else first
            found = {c: within_runs(keys, batch.column(c).to_numpy(), last, so_far[c], m) for c, m in sums.items()}
            last, so_far = int(keys[-1]), {c: int(x[-1]) for c, x in found.items()}
            columns = [*(batch.column(f.name) for f in kept), *(pa.array(x, pa.int64()) for x in found.values())]
            columns += [pa.array(np.full(len(keys), task, np.int32)), pa.array(keys == first)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    held = written(placed.mapInArrow(add, T.StructType(fields)).withColumn("_at", F.monotonically_increasing_id()), name)
    runs = [f"run_{c}" for c in sums]
    # of each task: its first key, its last key, and that one's sums at its end
    edges = held.groupBy("_task").agg(F.min(key).alias("first"), F.max_by(F.struct(F.col(key).alias("last"), *runs), "_at").alias("end"))
    chain, key_before, before = [], None, [0] * len(sums)
    for e in edges.orderBy("_task").collect():  # one row a task
        carried = before if e.first == key_before else [0] * len(sums)
        if any(carried):
            chain.append((e._task, *carried))
        own = [e.end[r] for r in runs]
        if e.end.last == e.first:  # all of the task is one key's
            own = [(a + b) % m if m else a + b for a, b, m in zip(own, carried, sums.values())]
        key_before, before = e.end.last, own
    out = held.drop("_at")
    if not chain:
        return out.drop("_task", "_first")
    added = rows.sparkSession.createDataFrame(chain, "_task int, " + ", ".join(f"_add_{r} long" for r in runs))
    out = out.join(F.broadcast(added), "_task", "left")
    for r, m in zip(runs, sums.values()):
        whole = F.col(r) + F.when(F.col("_first"), F.coalesce(F.col(f"_add_{r}"), F.lit(0))).otherwise(0)
        out = out.withColumn(r, whole % m if m else whole)
    return out.drop("_task", "_first", *[f"_add_{r}" for r in runs])
