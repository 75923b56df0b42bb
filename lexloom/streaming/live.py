"""Live forms: tails of rolled and of growing metric logs, and the annealer as a stateful operator."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..sources.metrics import schema, whole_lines
from .line_sources import log_lines


def tail_metrics(spark: SparkSession, folder: str, fields: list[str], checkpoint: str, show: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls show(rows, batch) for the records of each new file in a folder. Writers roll files (one
    per flush): bytes appended to a file that has been read are not read again (`follow_metrics` reads a
    growing file). A broken last line of a file is passed over, another broken line is an error. The
    checkpoint keeps the position over restarts."""
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def each(rows: DataFrame, batch: int) -> None:
        place = F.struct("_block", F.monotonically_increasing_id().alias("line"))
        held = rows.withColumn("_at", place).filter("trim(value) <> ''").persist()  # numbered once: the same lines in both uses
        try:
            show(whole_lines(held, fields), batch)
        finally:
            held.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_stream(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """The records that are appended to a log (a file or a folder), as a stream: (file, at, step, mix, fields). Each byte is
    read once; a line is a record once its end is written, a whole line that is no JSON is an error."""
    lines = log_lines(spark, path).filter("trim(value) <> ''")
    record = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema(fields)))
    sure = record.otherwise(F.raise_error(F.concat(F.lit("a broken line in "), "file", F.lit(" at "), F.col("at").cast("string"))))
    return lines.select("file", "at", sure.alias("r")).select("file", "at", "r.*")


def follow_metrics(spark: SparkSession, path: str, fields: list[str], checkpoint: str, show: Callable[[DataFrame, int], None], wait: str | None = None) -> StreamingQuery:
    """Calls show(rows, batch) with the new records of a growing log, in batches without a gap or a repeat, also over
    restarts; not for nothing new. wait: how often to look (`5 seconds`); None: what is there now, then stop. A batch
    that failed comes again under its number."""

    def each(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            show(rows, batch)

    out = metric_stream(spark, path, fields).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=wait).start() if wait else out.trigger(availableNow=True).start()


class Annealer(StatefulProcessor):
    """Per run: rows seen, progress, and the steps that are not due yet, as the watermark has not reached them."""

    def __init__(self, steps: int, threshold: float, offset: int):
        self.steps, self.threshold, self.offset = steps, threshold, offset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "seen long, progress long")
        self.waiting = handle.getListState("waiting", "at long, step long, loss double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.assign(ms=part["at"].astype("datetime64[ms]").astype("int64"))
            self.waiting.appendList([(int(r.ms), int(r.step), float(r.loss)) for r in part.itertuples()])
            first = min(part.ms.min(), first if first is not None else part.ms.min())
        if first is not None:
            self.handle.registerTimer(int(first))
        yield pd.DataFrame({"run_id": [], "step": [], "progress": []}).astype({"run_id": str, "step": "int64", "progress": "int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get())
        due, later = [r for r in held if r[0] <= reached], [r for r in held if r[0] > reached]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(later[0][0]))
        else:
            self.waiting.clear()
        seen, progress = self.done.get() if self.done.exists() else (0, 0)
        out = []
        for _, step, loss in due:
            seen += 1
            if seen > self.offset and math.isfinite(loss) and loss <= self.threshold:
                progress = min(self.steps, progress + 1)
            out.append((key[0], step, progress))
        self.done.update((seen, progress))
        yield pd.DataFrame(out, columns=["run_id", "step", "progress"]).astype({"run_id": str, "step": "int64", "progress": "int64"})


def anneal_stream(rows: DataFrame, steps: int, threshold: float, offset: int, delay: str = "10 minutes") -> DataFrame:
    """Stream of (run_id, step, at, loss) to (run_id, step, progress): per run, in the order of time and step, how many
    steps have qualified so far, as `anneal` counts them in a batch.

    at: when the step was. Steps may come in any order, `delay` behind the latest at most (later ones are
    dropped): a step waits in the state until the watermark has passed it. Progress and waiting steps are in
    the checkpoint. Needs the RocksDB state store, which this sets for the session."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    typed = rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("step").cast("long").alias("step"), F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("loss").cast("double"), F.lit(float("nan"))).alias("loss"))
    return typed.withWatermark("at", delay).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Annealer(steps, threshold, offset), outputStructType="run_id string, step long, progress long", outputMode="Append", timeMode="EventTime"
    )
