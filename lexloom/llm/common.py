"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import bound_batches  # noqa: F401

#: Words: runs of characters other than ASCII space, tab, line feed, vertical tab, form feed and
#: carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tidy() -> None:
    """Gives what a step has freed back to the system: Spark gives a worker to the next step as it is, and what
    its allocators keep would count beside that step's own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def forget_units() -> None:
    """Empties the stores of encoded units that an earlier tokenizer step has left in this worker."""
    held = sys.modules.get(f"{__package__}.byte_bpe")
    if held is not None:
        held.library_ids.cache_clear()
        held.prefix_counts.cache_clear()
    tidy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the
    checkpoint folder of the context, else (local sessions only) a folder below the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = held.get() if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: The tables written since the innermost operator under way began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read again: a cut of the lineage that
    outlives lost executors. Within a `cleaned` operator the table goes once its result is written."""
    path = scratch_path(df.sparkSession, what)
    if (made := _made.get()) is not None:
        made.append(path)
    # what is written on the way is mostly hashes, which no codec makes smaller; its buffers lie beside the heap
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of what finished steps hold: Spark deletes a shuffle's files once nothing on the driver names
    it any more, which without this is when the driver's memory happens to be collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cleaned(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written to the shared folder, after which the tables that it wrote on
    the way are deleted, also if it fails: a run leaves one table, not all its steps."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        made: list[str] = []
        token = _made.set(made)
        try:
            out = operator(*args, **kwargs)
            _made.reset(token)
            token = None
            done = written(out, operator.__name__)
            del out
        finally:
            if token is not None:
                _made.reset(token)
            context = SparkSession.active().sparkContext
            for path in made:
                place = context._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        release(done.sparkSession)
        return done

    return run
