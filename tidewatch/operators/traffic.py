"""Queries and aggregates over the traffic log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.scans import one_row
from tidewatch.schemas import ORDERABLE

BENIGN = "benign"


def check_range(name: str, value: int, low: int, high: int) -> int:
    """Bounds of the report parameters, for example hours 1..720 or bins 5..20."""
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, got {value}")
    return value


def last_hours(df: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Rows of the ``hours`` before ``as_of``, both ends included."""
    check_range("hours", hours, 1, 720)
    return df.where(F.col("timestamp").between(F.lit(as_of - dt.timedelta(hours=hours)), F.lit(as_of)))


def search(
    df: DataFrame, *, start: dt.datetime | None = None, end: dt.datetime | None = None,
    source_ip: str | None = None, threat_type: str | None = None, action: str | None = None,
    risk_level: str | None = None, min_risk_score: float | None = None,
) -> DataFrame:
    """Conjunction of the predicates that are given."""
    equal = {"source_ip": source_ip, "threat_type": threat_type, "action": action, "risk_level": risk_level}
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end))
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if min_risk_score is not None:
        df = df.where(F.col("risk_score") >= min_risk_score)
    return df


def threats_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("threat_type") != BENIGN)


def ordered(df: DataFrame, order_by: str = "timestamp", descending: bool = True) -> DataFrame:
    """Sort by an allowed column, ``timestamp`` otherwise; ties are broken by id."""
    name = order_by if order_by in ORDERABLE else "timestamp"
    return df.orderBy(F.col(name).desc() if descending else F.col(name).asc(), "id")


def page(df: DataFrame, limit: int = 50, offset: int = 0, order_by: str = "timestamp",
         descending: bool = True) -> DataFrame:
    """One page plus the total under the same predicates.

    ``offset`` sorts and drops the skipped rows; use ``page_after`` for deep pages.
    """
    check_range("limit", limit, 1, 1000)
    rows = ordered(df, order_by, descending).offset(offset).limit(limit)
    return rows.withColumn("total", df.agg(F.count(F.lit(1))).scalar())


def page_with_total(df: DataFrame, limit: int = 50, offset: int = 0, order_by: str = "timestamp", descending: bool = True) -> DataFrame:
    """One row: the total under the page's predicates and the page as an array of records.

    The total is there also when the page is empty; ``limit`` bounds the array.
    """
    rows = page(df, limit, offset, order_by, descending)
    key = F.col(order_by if order_by in ORDERABLE else "timestamp")
    place = F.row_number().over(Window.orderBy(key.desc() if descending else key.asc(), "id"))  # at most ``limit`` rows
    kept = rows.select(place.alias("place"), F.struct(*df.columns).alias("record"))
    listed = F.array_sort(F.collect_list(F.struct("place", "record")), lambda a, b: a["place"] - b["place"])
    held = kept.agg(F.transform(listed, lambda x: x["record"]).alias("rows"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("_all")).join(held.withColumn("_all", F.lit(1)), "_all").drop("_all")


def page_after(df: DataFrame, last_timestamp: dt.datetime, last_id, limit: int = 50) -> DataFrame:
    """Next page, newest first, after the last row of the page before (keyset paging)."""
    ts, at = F.col("timestamp"), F.lit(last_timestamp)
    older = df.where((ts < at) | ((ts == at) & (F.col("id") > F.lit(last_id))))
    return ordered(older).limit(limit)


def action_counters(df: DataFrame) -> DataFrame:
    """Totals per outcome and the two means; an empty input gives zeros."""
    def hits(value: str) -> Column:
        return F.count_if(F.col("action") == value)

    return df.agg(
        F.count(F.lit(1)).alias("total_requests"),
        hits("block").alias("blocked_requests"),
        hits("allow").alias("allowed_requests"),
        hits("challenge").alias("challenged_requests"),
        F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("avg_processing_time_ms"),
    )


def distribution(df: DataFrame, column: str, when_null: str | None = None) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(when_null)) if when_null else F.col(column)
    return df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("cnt"))


def label_counts(df: DataFrame) -> DataFrame:
    """Counts by threat type, by action and by risk level in one pass over the log."""
    labels = ["threat_type", "action", "risk_level"]
    combos = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("c"))
    long = combos.select("c", F.explode(F.array(*[
        F.struct(F.lit(x).alias("dimension"), F.col(x).alias("label")) for x in labels
    ])).alias("e"))
    return long.groupBy("e.dimension", "e.label").agg(F.sum("c").alias("cnt"))


def overview(df: DataFrame, top: int = 10, top_threats: int = 5) -> DataFrame:
    """The one-row summary: counters, means, three count maps, top sources and threats.

    Every section re-aggregates the log reduced to (source, labels). The counting sections
    share one exchange; the totals, which read two more columns, take a second scan. Raw
    rows are never shuffled: both reductions combine on the map side first.
    """
    labels = ["threat_type", "action", "risk_level"]
    base = df.groupBy("source_ip", *labels).agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("risk_score").alias("risk"), F.count("risk_score").alias("risk_n"),
        F.sum("processing_time_ms").alias("time"), F.count("processing_time_ms").alias("time_n"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )

    def hits(value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("action") == value, F.col("c"))), F.lit(0))

    totals = base.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_requests"),
        hits("block").alias("blocked_requests"), hits("allow").alias("allowed_requests"),
        hits("challenge").alias("challenged_requests"),
        F.coalesce(F.try_divide(F.sum("risk"), F.sum("risk_n")), F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce(F.try_divide(F.sum("time"), F.sum("time_n")), F.lit(0.0)).alias("avg_processing_time_ms"),
        F.min("first_ts").alias("time_range_start"), F.max("last_ts").alias("time_range_end"),
    )

    def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
        pair = F.struct((-F.col("cnt")).alias("neg"), F.col(key).alias("k"))
        listed = F.transform(F.sort_array(F.collect_list(pair)), lambda p: F.concat_ws("=", p["k"], (-p["neg"]).cast("string")))
        return rows.agg(F.concat_ws(",", listed).alias(name))

    sections = [totals]
    for label in labels:
        cnt = base.groupBy(label).agg(F.sum("c").alias("cnt"))
        sections.append(ranked(cnt, label, f"{label}_counts"))
    sources = base.groupBy("source_ip").agg(F.sum("c").alias("cnt"))
    sections.append(ranked(sources.orderBy(F.desc("cnt"), "source_ip").limit(top), "source_ip", "top_source_ips"))
    # a filter on the label would be pushed below ``base`` and force a second scan of the log
    harmful = F.when(F.col("threat_type") != BENIGN, F.col("c"))
    threats = base.groupBy("threat_type").agg(F.sum(harmful).alias("cnt")).where("cnt IS NOT NULL")
    sections.append(ranked(threats.orderBy(F.desc("cnt"), "threat_type").limit(top_threats), "threat_type", "top_threat_types"))
    return one_row(*sections)


def top_sources(df: DataFrame, limit: int = 10, threat_only: bool = False) -> DataFrame:
    rows = threats_only(df) if threat_only else df
    return distribution(rows, "source_ip").orderBy(F.desc("cnt"), "source_ip").limit(limit)


def top_threat_types(df: DataFrame, limit: int = 5) -> DataFrame:
    return distribution(threats_only(df), "threat_type").orderBy(F.desc("cnt"), "threat_type").limit(limit)


def recent_threats(df: DataFrame, limit: int = 20) -> DataFrame:
    """Newest non-benign rows; the filter comes before the limit."""
    return ordered(threats_only(df)).limit(check_range("limit", limit, 1, 100))


def timeline(df: DataFrame, start: dt.datetime, interval_minutes: int = 60) -> DataFrame:
    """Totals per interval counted from ``start``; intervals without rows are absent."""
    check_range("interval_minutes", interval_minutes, 5, 1440)
    step = interval_minutes * 60_000_000
    origin = F.unix_micros(F.lit(start).cast("timestamp"))
    bucket = F.floor((F.unix_micros("timestamp") - origin) / step).cast("bigint")
    return (
        df.groupBy(bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("action") == "block").alias("blocked"),
            F.count_if(F.col("threat_type") != BENIGN).alias("threats"),
        )
        .select(F.timestamp_micros(origin + F.col("bucket") * step).alias("bucket_start"), "total", "blocked", "threats")
    )


def risk_histogram(df: DataFrame, bins: int = 10, compat: bool = False) -> DataFrame:
    """Equal bins ``[low, high)`` over 0..1, empty bins kept.

    The last bin also takes the score 1.0; ``compat=True`` leaves it out of every bin.
    """
    check_range("bins", bins, 5, 20)
    size = F.lit(1.0 / bins)
    score = F.col("risk_score")
    guess = F.floor(score * bins)
    # the edges are i * size in floating point, so the guess can be off by one
    exact = guess - (score < guess * size).cast("int") + (score >= (guess + 1) * size).cast("int")
    if not compat:
        exact = F.when((exact == bins) & (score <= 1.0), bins - 1).otherwise(exact)
    found = df.select(exact.cast("bigint").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    low, high = F.col("bin") * size, (F.col("bin") + 1) * size
    # at most 20 labels, rounded once here because engines round ties differently
    labels = F.array(*[F.lit(f"{i * (1.0 / bins):.1f}-{(i + 1) * (1.0 / bins):.1f}") for i in range(bins)])
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(found, "bin", "left").select(
        "bin", F.get(labels, F.col("bin").cast("int")).alias("label"),
        low.alias("low"), high.alias("high"), F.coalesce("c", F.lit(0)).alias("cnt"),
    )


def protection_counters(df: DataFrame) -> DataFrame:
    """Counters of the protection service and its block rate in percent."""
    blocked = F.count_if(F.col("action") == "block")
    total = F.count(F.lit(1))
    threat = F.col("threat_type") != BENIGN
    return df.agg(
        total.alias("total_requests"), blocked.alias("blocked_requests"),
        (total - blocked).alias("allowed_requests"), F.count_if(threat).alias("threats_detected"),
        F.round(F.lit(100.0) * blocked / F.greatest(total, F.lit(1)), 2).alias("block_rate"),
        F.max(F.when(threat, F.col("timestamp"))).alias("last_threat_time"),
    )
