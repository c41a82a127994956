"""The traffic log as a partitioned Parquet table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.runtime import materialize
from tidewatch.schemas import ACTIONS, PREDICTION, RISK_LEVELS, THREAT_TYPES, TRAFFIC_LOG

DATE = "date"
#: Fixed value: the folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
STRINGS = T.MapType(T.StringType(), T.StringType())


def to_json(log: DataFrame) -> DataFrame:
    """One JSON text per record."""
    return log.select("id", F.to_json(F.struct(*log.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))


def from_json(rows: DataFrame, schema: T.StructType = TRAFFIC_LOG, json: str = "json") -> DataFrame:
    """Records from JSON text. Labels outside the enumerations become null."""
    parsed = rows.select(F.from_json(json, schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}).alias("r")).select("r.*")
    return parsed.withColumns({c: checked(c, v) for c, v in (("threat_type", THREAT_TYPES), ("action", ACTIONS), ("risk_level", RISK_LEVELS)) if c in schema.names})


def checked(column: str, allowed: list[str]) -> Column:
    return F.when(F.col(column).isin(allowed), F.col(column))


# --- fixed values: what an empty cell means when a stored row is read ---------------------
DEFAULTS = {
    "source_ip": "", "source_port": 0, "dest_ip": "", "dest_port": 0, "protocol": "HTTP", "method": "GET",
    "url": "", "user_agent": "", "threat_type": "benign", "risk_level": "safe", "risk_score": 0.0,
    "action": "allow", "ensemble_score": 0.0, "processing_time_ms": 0.0,
}


def decode(stored: DataFrame) -> DataFrame:
    """Rows of a flat store: nulls get their defaults, JSON text becomes nested values, and
    the geo columns become one struct that is null without a country."""
    have = set(stored.columns)
    out = stored.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")) if isinstance(v, str) else F.col(c), F.lit(v))
                              for c, v in DEFAULTS.items() if c in have})
    nested = {"predictions": (T.ArrayType(PREDICTION), F.array().cast(T.ArrayType(PREDICTION))),
              "features": (STRINGS, F.create_map().cast(STRINGS)), "metadata": (STRINGS, F.create_map().cast(STRINGS))}
    for c, (kind, empty) in nested.items():
        if c in have:
            out = out.withColumn(c, F.coalesce(F.from_json(F.col(c), kind), empty))
    for c in ("captcha_required", "captcha_passed"):
        if c in have:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    if "geo_country" in have:
        def text(c: str) -> Column:
            return F.coalesce(F.col(c), F.lit("Unknown")) if c in have else F.lit("Unknown")

        def number(c: str) -> Column:
            return F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)

        geo = F.struct(F.col("geo_country").alias("country"), F.lit("XX").alias("country_code"), text("geo_city").alias("city"),
                       number("geo_latitude").alias("latitude"), number("geo_longitude").alias("longitude"))
        out = out.withColumn("geo_location", F.when(F.col("geo_country").isNotNull() & (F.col("geo_country") != ""), geo))
        out = out.drop("geo_country", "geo_city", "geo_latitude", "geo_longitude")
    return out


#: Bits a row and hash functions of a file's id filter (about one false hit in 900), and most ids of a batch looked up through it.
FILTER_BITS, FILTER_HASHES, MOST_IDS = 16, 6, 20_000
INDEX = "_index"


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each hash in a filter of that size."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + np.arange(FILTER_HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


def _filter_of(key: tuple, rows: pa.Table) -> pa.Table:
    """The id filter of a file: as many rows as the file has, one number each."""
    hashes = rows.column("h").to_numpy().view(np.uint64)
    bits = np.zeros(max(64, -(-FILTER_BITS * len(hashes) // 64) * 64), np.uint8)
    bits[_places(hashes, len(bits)).ravel()] = 1
    return pa.table({"file": pa.array([key[0].as_py()], pa.string()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _may_hold(bits: bytes, hashes: np.ndarray) -> bool:
    table = np.unpackbits(np.frombuffer(bits, np.uint8))
    return bool(table[_places(hashes, len(table))].all(axis=1).any())


class LogTable:
    """Append-only log partitioned by day, so time ranges prune whole folders.

    Every data file has a filter of its ids in an index beside the data, so a lookup and the check for ids that are
    stored already open only the files that may hold them. Files without a filter, such as those of a write that broke off
    before it was indexed, are opened as well; entries of files that are gone are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = TRAFFIC_LOG) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(DATE, T.DateType())])).parquet(self.path)
        for bound, low in ((start, True), (end, False)):
            if bound is not None:
                day, at = F.lit(bound.date()), F.lit(bound)
                rows = rows.where((F.col(DATE) >= day) & (F.col("timestamp") >= at) if low else (F.col(DATE) <= day) & (F.col("timestamp") <= at))
        return rows.drop(DATE)

    def append(self, log: DataFrame) -> None:
        self._written(log, "append")

    def append_new(self, log: DataFrame, lateness: dt.timedelta | None = None) -> int:
        """Append the rows whose id is not stored yet, the earliest one per id; returns how
        many were written.

        Only ids are compared with the table, and for a batch of up to ``MOST_IDS`` ids only with files whose filter
        may hold one of them. With ``lateness`` only the days of the batch,
        and so much before and after, are scanned: an id that comes back later than that
        is stored again.
        """
        first = log.groupBy("id").agg(F.min_by(F.struct(*log.columns), "timestamp").alias("r")).select("r.*")
        start = end = None
        if lateness is not None:
            span = log.agg(F.min("timestamp"), F.max("timestamp")).first()
            start, end = (span[0] - lateness, span[1] + lateness) if span[0] else (None, None)
        ids = [r["h"] for r in first.select(F.xxhash64(F.col("id").cast("string")).alias("h")).limit(MOST_IDS + 1).collect()]
        stored = self.read(start, end) if len(ids) > MOST_IDS else self._in_files(self._files_with(ids, start, end), start, end)
        fresh = first.join(stored.select("id"), "id", "left_anti").select(*log.columns)
        fresh = materialize(fresh, "fresh")  # counted and appended
        self.append(fresh)
        return fresh.count()

    def get(self, log_id, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """The record with the id; only files that may hold it are opened, of these only row groups that may."""
        return self._in_files(self.files_of(log_id, start, end), start, end).where(F.col("id") == F.lit(log_id))

    def files_of(self, log_id, start: dt.datetime | None = None, end: dt.datetime | None = None) -> list[str]:
        """The files that a lookup of the id opens."""
        wanted = F.lit(log_id).cast(self.schema["id"].dataType).cast("string")
        return self._files_with([self.spark.range(1).select(F.xxhash64(wanted).alias("h")).first()["h"]], start, end)

    def files(self, start: dt.datetime | None = None, end: dt.datetime | None = None) -> list[str]:
        """All files of the days in the range, by a listing alone."""
        if not self._exists():
            return []
        named = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(DATE, T.DateType())])).parquet(self.path).inputFiles()
        low, high = (x.date().isoformat() if x else None for x in (start, end))

        def wanted(file: str) -> bool:
            day = file.rsplit("/", 2)[-2].split("=", 1)[-1]
            return (low is None or day >= low) and (high is None or day <= high) if day != NO_DAY else not (low or high)

        return [f for f in named if wanted(f)]

    def _index(self) -> DataFrame | None:
        fs, _ = self._fs()
        path = f"{self.path}/{INDEX}"
        if not fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
            return None
        return self.spark.read.schema("file string, bits binary").parquet(path)

    def _files_with(self, hashes: list[int], start: dt.datetime | None, end: dt.datetime | None) -> list[str]:
        """Files of the range that may hold one of the ids, by their filters."""
        now, index = {"/".join(f.rsplit("/", 2)[-2:]): f for f in self.files(start, end)}, self._index()
        if index is None or not now:
            return sorted(now.values())
        sent = np.array(hashes, np.int64).view(np.uint64)  # at most MOST_IDS

        def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [len(sent) > 0 and _may_hold(x.as_buffer(), sent) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], names=["file", "hit"])

        known = {r["file"]: r["hit"] for r in index.mapInArrow(hit, "file string, hit boolean").collect()}  # a name and a flag a file, as the listing
        return sorted(f for name, f in now.items() if known.get(name, True))

    def _in_files(self, files: list[str], start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField(DATE, T.DateType())])
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*files)
        for bound, low in ((start, True), (end, False)):
            if bound is not None:
                rows = rows.where(F.col("timestamp") >= F.lit(bound) if low else F.col("timestamp") <= F.lit(bound))
        return rows.drop(DATE)

    def _add_to_index(self) -> None:
        """Filters of the files that have none; a call that broke off is made up for by the next one."""
        index = self._index()
        known = {r["file"] for r in index.select("file").collect()} if index is not None else set()
        new = [f for f in self.files() if "/".join(f.rsplit("/", 2)[-2:]) not in known]
        if not new:
            return
        name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1)
        ids = self.spark.read.schema(T.StructType([self.schema["id"]])).option("basePath", self.path).parquet(*new).select(name.alias("file"), F.xxhash64(F.col("id").cast("string")).alias("h"))
        ids.groupBy("file").applyInArrow(_filter_of, "file string, bits binary").write.mode("append").parquet(f"{self.path}/{INDEX}")

    def delete_before(self, cutoff: dt.datetime) -> int:
        """Delete rows strictly older than ``cutoff``; returns how many went.

        Days before the cutoff are removed as folders; then the day of the cutoff is
        rewritten, from a copy of the rows to keep. Rows without a time stay. Every step can be
        repeated, so a delete that broke off is finished by calling it again.
        """
        old = self.read(end=cutoff).where(F.col("timestamp") < F.lit(cutoff))
        gone = old.count()
        if gone == 0:
            return 0
        day = cutoff.date()
        midnight, last = dt.datetime.combine(day, dt.time.min), dt.datetime.combine(day, dt.time.max)
        kept = materialize(self.read(start=cutoff, end=last), "kept")
        survivors = not kept.isEmpty()
        fs, path = self._fs()
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith(f"{DATE}=") and name != f"{DATE}={NO_DAY}":
                d = dt.date.fromisoformat(name.split("=", 1)[1])
                if d < day or (d == day and not survivors and midnight < cutoff):
                    fs.delete(status.getPath(), True)
        if survivors:
            self._written(kept, "overwrite", partitionOverwriteMode="dynamic")
        return gone

    def clear(self) -> int:
        """Delete every row; returns how many went."""
        n = self.read().count()
        empty = self.spark.createDataFrame([], self.schema)
        self._written(empty, "overwrite")
        return n

    def _written(self, log: DataFrame, mode: str, **options: str) -> None:
        writer = log.withColumn(DATE, F.to_date("timestamp")).write.mode(mode).options(**options)
        writer.option("parquet.bloom.filter.enabled#id", "true").partitionBy(DATE).parquet(self.path)
        self._add_to_index()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path)
