"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.runtime import materialize, shared_dir

__all__ = ["fold", "list_matrix", "map_texts", "materialize", "shared_dir", "small_batches", "table", "utf8_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's text modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


#: Rows of a record batch: texts can be long, and a task holds a batch more than once.
BATCH_ROWS = 1_024
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Keep the record batches of this session at ``BATCH_ROWS`` rows or less."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ROWS_SETTING)) <= BATCH_ROWS:
        conf.set(ROWS_SETTING, str(BATCH_ROWS))
    return df


def map_texts(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Apply a batch function to ``columns`` of ``df``; ``make`` runs once per task.

    The function gets record batches and returns record batches, so state built by
    ``make`` (tables, caches) is shared by the batches of a task only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            if batch.num_rows:
                yield step(batch)

    return small_batches(df).select(*columns).mapInArrow(run, schema)


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = texts.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def list_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a float64 matrix; shorter rows end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.zeros((len(vectors), width))
    if len(vectors):
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if (sizes == width).all():
            return flat.reshape(len(vectors), width)
        out[np.repeat(np.arange(len(vectors)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
