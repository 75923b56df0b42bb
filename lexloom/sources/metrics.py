"""Metric logs: JSON lines, one record per logged step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(fields: list[str]) -> T.StructType:
    """step, mix and numeric fields, all others null where a record lacks them."""
    return T.StructType([T.StructField("step", T.LongType()), T.StructField("mix", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in fields]])


def read_metrics(spark: SparkSession, path: str, fields: list[str], tolerant: bool = False) -> DataFrame:
    """The records in a log. A broken line is an error; tolerant: a broken last line is passed over."""
    if not tolerant:
        return spark.read.schema(schema(fields)).option("mode", "FAILFAST").json(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), place.alias("_at")).filter("trim(value) <> ''")
    return whole_lines(lines, fields)


def whole_lines(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Lines (value, _file, _at) as records: a broken line is passed over if it is its file's last, else an
    error when read."""
    last = lines.groupBy("_file").agg(F.max("_at").alias("_last"))
    # one expression, so that no filter for whole lines runs before the check
    whole = F.when(F.try_parse_json("value").isNotNull(), True).when(F.col("_at") == F.col("_last"), False)
    whole = whole.otherwise(F.raise_error(F.lit("a line is broken that is not the last")).cast("boolean"))
    kept = lines.join(last, "_file").filter(whole)
    return kept.select(F.from_json("value", schema(fields)).alias("r")).select("r.*")


def append_metrics(rows: DataFrame, path: str, batch: int | str, every: int = 1) -> None:
    """Adds the records of each `every`th step to a log, once a batch: a batch (its number or name) has a folder of its
    own, so one that failed and comes again replaces what it left. Use it as `foreachBatch` has it, or under
    the name of a piece of work."""
    rows.filter(F.col("step") % every == 0).write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def read_batches(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """The records of a log of `append_metrics`: of batches that were written in full (Spark marks them), others
    are not seen."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [f.getPath().toString() for f in files.listStatus(place)] if files.exists(place) else []
    whole = [f for f in whole if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
    return spark.read.schema(schema(fields)).option("mode", "FAILFAST").json(whole) if whole else spark.createDataFrame([], schema(fields))
