"""Streaming sources over lines of files: a growing log, and an endless corpus.

Both are readers of Spark's Python data source API. Their offsets name files and bytes, so the
checkpoint of a query holds the exact position, also in the middle of a file."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..sources.byte_lines import Span, end_of_lines, listed, next_line, read_span, spans, zipped

#: Bytes of a task of a batch.
TASK_BYTES = 64 << 20


class LogLines(DataSource):
    """Lines that are appended to a file, or to the files of a folder: (file, at, value)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


class LogReader(DataSourceStreamReader):
    """Offsets: for each file the bytes up to its last whole line. A last line without an end is not yet
    written in full, and waits; a missing file has no lines yet; a file that got shorter is an error."""

    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes, self.at = path, task_bytes, None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.at, old = dict(self.at or {}), self.at or {}
        for path, size in listed(self.path).items():
            if zipped(path):
                raise ValueError(f"a growing log cannot be gzipped: {path}")
            if size < old.get(path, 0):
                raise ValueError(f"{path} has {size} bytes, of which {old[path]} had been read")
            self.at[path] = end_of_lines(path, old.get(path, 0), size)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = self.at or end  # a restarted query plans its last batch first
        return [s for path, last in sorted(end.items()) for s in spans(path, start.get(path, 0), last, self.task_bytes, (start.get(path, 0),))]

    def read(self, partition: Span) -> Iterator[tuple]:
        first = partition.labels[0]
        for at, line in read_span(partition, whole_start=partition.begin == first):
            yield partition.path, at, line


def log_lines(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The stream of lines of a growing file or folder; each byte is read once, but the ends of tasks."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("log_lines").option("task_bytes", task_bytes).load(path)


def pass_order(files: int, seed: int, epoch: int) -> list[int]:
    """The files' numbers in the order of a pass: shuffled anew at the end of each pass, as `path_orders` has it."""
    pick, now = random.Random(seed), list(range(files))
    for _ in range(epoch + 1):
        pick.shuffle(now)
    return now


class EndlessLines(DataSource):
    """Lines of a corpus' files, pass after pass: (epoch, path_ord, path_no, at, text)."""

    @classmethod
    def name(cls) -> str:
        return "endless_lines"

    def schema(self) -> str:
        return "epoch int, path_ord int, path_no int, at long, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        passes = int(o["passes"]) if o.get("passes") else None
        return EndlessReader(json.loads(o["files"]), int(o.get("seed", 0)), int(o.get("batch_bytes", 1 << 30)), passes, int(o.get("task_bytes", TASK_BYTES)))


class EndlessReader(DataSourceStreamReader):
    """Offsets: pass, place in that pass' order, byte; with the files and the seed, which must stay as they are.

    A batch takes about `batch_bytes` on from the last one, over the ends of files and passes (a gzipped
    file as a whole), so an endless corpus comes in batches of one size. Files are not to change."""

    def __init__(self, files: list[str], seed: int, batch_bytes: int, passes: int | None, task_bytes: int):
        self.files, self.seed, self.batch_bytes, self.passes, self.task_bytes = files, seed, batch_bytes, passes, task_bytes
        self.at: dict | None = None
        self.sizes: list[int] | None = None

    def initialOffset(self) -> dict:
        return {"epoch": 0, "place": 0, "byte": 0, "seed": self.seed, "files": self.files}

    def known_sizes(self) -> list[int]:
        if self.sizes is None:
            self.sizes = [listed(f)[f] for f in self.files]
            if not any(line.strip() for f, n in zip(self.files, self.sizes) for _, line in read_span(Span(f, 0, n), True)):
                raise ValueError("a whole pass over the corpus holds no example")
        return self.sizes

    def checked(self, offset: dict) -> dict:
        if offset["files"] != self.files or offset["seed"] != self.seed:
            raise ValueError("the saved position is one of other files or of another order")
        return offset

    def latestOffset(self) -> dict:
        sizes, now = self.known_sizes(), dict(self.checked(self.at or self.initialOffset()))
        left = self.batch_bytes
        order = pass_order(len(self.files), self.seed, now["epoch"])
        while left > 0 and (self.passes is None or now["epoch"] < self.passes):
            file = order[now["place"]]
            size, path = sizes[file], self.files[file]
            if now["byte"] + left < size and not zipped(path):
                now["byte"] = max(next_line(path, now["byte"] + left, size), now["byte"] + 1)
                left = 0
            else:
                left -= size - now["byte"]
                now["byte"] = size
            if now["byte"] >= size:
                now |= {"place": now["place"] + 1, "byte": 0}
                if now["place"] == len(order):
                    now |= {"epoch": now["epoch"] + 1, "place": 0}
                    order = pass_order(len(self.files), self.seed, now["epoch"])
        self.at = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if self.at is None:  # a restarted query plans its last batch first
            self.at = self.checked(end)
        sizes, out = self.known_sizes(), []
        epoch, place, byte = start["epoch"], start["place"], start["byte"]
        order = pass_order(len(self.files), self.seed, epoch)
        while (epoch, place, byte) < (end["epoch"], end["place"], end["byte"]):
            file = order[place]
            last = end["byte"] if (epoch, place) == (end["epoch"], end["place"]) else sizes[file]
            out += spans(self.files[file], byte, last, self.task_bytes, (byte, epoch, place, file))
            if last < sizes[file]:
                break
            place, byte = place + 1, 0
            if place == len(order):
                epoch, place = epoch + 1, 0
                order = pass_order(len(self.files), self.seed, epoch)
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        first, epoch, place, file = partition.labels
        for at, line in read_span(partition, whole_start=partition.begin == first):
            if line.strip():
                yield epoch, place, file, at, line


def endless_lines(spark: SparkSession, files: list[str], seed: int = 0, batch_bytes: int = 1 << 30, passes: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The stream of a corpus' lines that are not blank, for ever or `passes` times. Rows of a batch are ordered by
    (epoch, path_ord, at). The query's checkpoint keeps the position; another seed or other files than its
    are an error."""
    spark.dataSource.register(EndlessLines)
    options = {"files": json.dumps(list(files)), "seed": seed, "batch_bytes": batch_bytes, "task_bytes": task_bytes}
    if passes is not None:
        options["passes"] = passes
    return spark.readStream.format("endless_lines").options(**options).load()
