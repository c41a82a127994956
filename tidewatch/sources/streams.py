"""Streaming sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.runtime import shared_dir
from tidewatch.sources.log_table import LogTable


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive in a folder; the trigger bounds one micro-batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def any_stream(spark: SparkSession, kind: str, options: dict[str, str]) -> DataFrame:
    """Any other source, for example ``kafka``."""
    return spark.readStream.format(kind).options(**options).load()


def sink_to_log(stream: DataFrame, table: LogTable, checkpoint: str):
    """Write a log stream. A repeated micro-batch finds its ids stored and adds nothing,
    which makes the sink idempotent."""
    def write(batch: DataFrame, _: int) -> None:
        table.append_new(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, name: str, folder: str | None) -> tuple[str, str]:
    """Output and checkpoint of a stream: below the caller's folder, or fresh ones."""
    base = folder.rstrip("/") if folder else shared_dir(spark, name)
    return f"{base}/output", f"{base}/checkpoint"


def drain(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over everything available and return its output table.

    With a ``folder`` of the caller's a later call goes on where this one stopped, also after
    a crash: a repeated micro-batch overwrites its own output. The table holds the output of
    all calls.
    """
    spark = stream.sparkSession
    target, checkpoint = _folders(spark, name, folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(target).drop("batch")


def drain_updates(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """The same in update mode: the newest version of every key."""
    spark = stream.sparkSession
    target, checkpoint = _folders(spark, name, folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(target)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


Handler = Callable[[DataFrame, int], None]


def for_each_batch(stream: DataFrame, name: str, handler: Handler, folder: str | None = None):
    """Run a handler over all available micro-batches; with a ``folder`` later calls go on from there."""
    _, checkpoint = _folders(stream.sparkSession, name, folder)
    run = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run
