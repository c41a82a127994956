"""Session helpers shared by batch and streaming operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one ordinal block. Stateful scans split every key into blocks of at most this
#: many rows, so one hot key never becomes one task (see ``operators.scans``).
BLOCK_ROWS = 1_000_000


def session(master: str = "local[*]", app: str = "tidewatch", **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; cluster settings win."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: HotSpot never compiles a method of more bytes. Generated code beyond that would run interpreted, several times slower,
#: so Spark splits it into the methods of single operators instead.
METHOD_LIMIT = 8000


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are compared and bucketed in UTC whatever the host zone is; wide rows run as compiled code."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > METHOD_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_LIMIT))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster.

    The cluster names that folder in ``spark.checkpoint.dir``. A temporary folder is used
    only by a local master, where driver and executors share one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several jobs read to the shared folder and read it back.

    Used where an iterative job would otherwise recompute its input per iteration; the
    written table survives executor loss, unlike a cached or locally checkpointed frame.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Session setting: number of partitions that CPU-heavy operators deal their input into.
SPREAD = "spark.tidewatch.spread"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over ``spark.tidewatch.spread`` partitions; without that setting the input stays as it lies.

    For tables in fewer splits than there are cores, and operators that spend much time per
    row. The caller decides; nothing is measured and no job is started.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df if df.isStreaming or not parts else df.repartition(int(parts))


def even(df: DataFrame, *ids: str, least: int = 0) -> DataFrame:
    """Rows in even parts, two for every core and ``least`` at least; ``spark.tidewatch.spread`` names another number than the
    former. With ``ids`` a row lies in the part of their hash."""
    spark = df.sparkSession
    return df.repartition(max(least, int(spark.conf.get(SPREAD, None) or 2 * spark.sparkContext.defaultParallelism)), *ids)


def dealt(df: DataFrame, name: str, *ids: str, least: int = 0) -> DataFrame:
    """``materialize`` in even parts, two for every core and ``least`` at least, for rows that are read many times.

    A table may lie in fewer splits than there are cores, since a file is split between its row
    groups only, and every pass would leave the other cores idle. ``spark.tidewatch.spread`` names
    another number of parts. With ``ids`` a row lies in the part of their hash, in their order:
    parts do not depend on how the input was split.
    """
    parts = even(df, *ids, least=least)
    return materialize(parts.sortWithinPartitions(*ids) if ids else parts, name)
