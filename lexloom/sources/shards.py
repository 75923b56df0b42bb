"""Sharded text with an index of records: a folder of shards that can be read by record number.

A shard is the UTF-8 of its records one after the other (`shard-00000.rec`) and a table of where each
ends (`shard-00000.idx`, 8 bytes a record). `shards.json` lists shards in order with their numbers of
records; records are numbered through. Written by tasks, listed when all are done: a folder
without the list, or a shard that is not on it (a failed task's), is not read."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .byte_lines import place

LIST = "shards.json"
#: Bytes of text that a task reads together.
TASK_BYTES = 64 << 20


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str
    records: int


@dataclass
class Records(InputPartition):
    """Records first to last - 1 of a shard, whose first record has the number `base`."""

    name: str
    base: int
    first: int
    last: int


class TextShards(DataSource):
    """(record, text) of a folder of shards; option `path`."""

    @classmethod
    def name(cls) -> str:
        return "text_shards"

    def schema(self) -> str:
        return "record long, text string"

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options["path"], overwrite)


class ShardReader(DataSourceReader):
    """Filters on the record number choose shards and records before anything is opened."""

    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path.rstrip("/"), task_bytes
        self.low, self.high, self.only = 0, 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if at != ("record",):
                yield f
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, value)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value + 1)
            elif isinstance(f, (EqualTo, In)):
                asked = set(value) if isinstance(f, In) else {value}
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def partitions(self) -> list[Records]:
        where, inner = place(self.path)
        with where.open_input_stream(f"{inner}/{LIST}") as file:
            shards = json.loads(file.read())
        bases = [0, *accumulate(s["records"] for s in shards)]
        if self.only is not None:
            asked = sorted(n for n in self.only if n is not None and self.low <= n < min(self.high, bases[-1]))
            return [Records(shards[i]["name"], bases[i], n - bases[i], n + 1 - bases[i]) for n in asked for i in [bisect_right(bases, n) - 1]]
        out = []
        for s, base in zip(shards, bases):
            first, last = max(self.low - base, 0), min(self.high - base, s["records"])
            step = max(1, s["records"] * self.task_bytes // max(1, s["bytes"]))
            out += [Records(s["name"], base, a, min(a + step, last)) for a in range(first, last, step)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        where, inner = place(self.path)
        first, last = partition.first, partition.last
        with where.open_input_file(f"{inner}/{partition.name}.idx") as index:
            before = max(first - 1, 0)
            ends = np.frombuffer(index.read_at(8 * (last - before), 8 * before), "<i8")
        ends = np.concatenate([[0], ends]) if first == 0 else ends
        with where.open_input_file(f"{inner}/{partition.name}.rec") as texts:
            at = 0
            while at < last - first:  # some megabytes at a time
                to = max(at + 1, min(int(np.searchsorted(ends, ends[at] + (4 << 20), "right")) - 1, last - first))
                body = texts.read_at(int(ends[to] - ends[at]), int(ends[at]))
                offsets = pa.array(ends[at : to + 1] - ends[at], pa.int64())
                text = pa.LargeStringArray.from_buffers(to - at, offsets.buffers()[1], pa.py_buffer(body)).cast(pa.string())
                numbers = pa.array(np.arange(first + at, first + to) + partition.base)
                yield pa.RecordBatch.from_arrays([numbers, text], names=["record", "text"])
                at = to


class ShardWriter(DataSourceArrowWriter):
    """A shard a task, under a name of its own; the list is written when all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, inner = place(self.path)
        where.create_dir(inner)
        context = TaskContext.get()
        task = context.partitionId()
        name = f"shard-{task:05d}-{self.run}-{context.attemptNumber()}"
        ends, at = [], 0
        with where.open_output_stream(f"{inner}/{name}.rec") as out:
            for batch in iterator:
                column = batch.column(batch.schema.get_field_index("text"))
                if column.null_count:
                    raise ValueError("a row has no text")
                for text in column.cast(pa.binary()).to_pylist():
                    out.write(text)
                    at += len(text)
                    ends.append(at)
        with where.open_output_stream(f"{inner}/{name}.idx") as out:
            out.write(np.array(ends, "<i8").tobytes())
        return Written(task, name, len(ends))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, inner = place(self.path)
        where.create_dir(inner)
        done = sorted((m for m in messages if isinstance(m, Written)), key=lambda m: m.task)
        old = []
        if where.get_file_info(f"{inner}/{LIST}").type == fs.FileType.File and not self.overwrite:
            with where.open_input_stream(f"{inner}/{LIST}") as file:
                old = json.loads(file.read())
        new = [{"name": m.name, "records": m.records, "bytes": where.get_file_info(f"{inner}/{m.name}.rec").size} for m in done if m.records]
        with where.open_output_stream(f"{inner}/_{LIST}") as out:
            out.write(json.dumps(old + new).encode())
        where.move(f"{inner}/_{LIST}", f"{inner}/{LIST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, inner = place(self.path)
        for m in messages:
            if isinstance(m, Written):
                for end in ("rec", "idx"):
                    where.delete_file(f"{inner}/{m.name}.{end}")


def write_shards(texts: DataFrame, path: str, text: str = "text", mode: str = "append") -> None:
    """Writes a column of texts as shards, one a partition, records in the order of rows. A null text is an error. mode:
    append goes on from the last record, overwrite starts anew (old shards are no longer listed)."""
    spark = texts.sparkSession
    spark.dataSource.register(TextShards)
    texts.select(F.lit(0).cast("long").alias("record"), F.col(text).alias("text")).write.format("text_shards").mode(mode).save(path)


def read_shards(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(record, text) of a folder of shards. A filter on `record` opens the shards that hold such records, and reads
    these records only."""
    spark.dataSource.register(TextShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("text_shards").option("task_bytes", task_bytes).load(path)
