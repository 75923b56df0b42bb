"""A Spark session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Bytes of an Arrow batch between Spark and a Python worker, where the session sets none.
BATCH_BYTES = "2m"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, not rows alone: a batch of 10,000 long texts would fill a worker's
    memory, and the executor's beside it. A session that has a limit keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def session(name: str = "lexloom", **settings: str) -> SparkSession:
    """The running session, or a new one."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a local session without one uses a folder
    below its warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


def settled(rows: DataFrame) -> DataFrame:
    """The rows, worked out now and kept in the shared folder: what follows reads them, and outlives lost executors."""
    context = rows.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()
