"""Streaming versions of the log reports and of the security state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BENIGN = "benign"


def live_timeline(log: DataFrame, interval: str = "60 minutes", offset: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Totals per tumbling window; ``offset`` moves the windows to another start."""
    timed = log.withWatermark("timestamp", delay)
    frame = F.window("timestamp", interval, interval, offset) if offset else F.window("timestamp", interval)
    return timed.groupBy(frame.alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "block").alias("blocked"),
        F.count_if(F.col("threat_type") != BENIGN).alias("threats"),
    ).select(F.col("w.start").alias("bucket_start"), "total", "blocked", "threats")


def live_counters(log: DataFrame) -> DataFrame:
    """Running protection counters; use update or complete mode."""
    threat = F.col("threat_type") != BENIGN
    return log.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("action") == "block").alias("blocked_requests"),
        F.count_if(threat).alias("threats_detected"), F.max(F.when(threat, F.col("timestamp"))).alias("last_threat_time"))


def unique_entries(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each id once; state is kept for ``delay`` of event time."""
    return log.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def live_traffic_state(packets: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Security indicators per target over sliding windows.

    Distinct sources and ports are sketched: an exact set per window would grow with the
    traffic of the target.
    """
    timed = packets.withColumn("at", F.timestamp_micros((F.col("ts_s") * 1_000_000).cast("bigint"))).withWatermark("at", delay)
    seconds = float(window.split()[0])
    grouped = timed.groupBy(F.window("at", window, slide).alias("w"), "dst_ip").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_size").alias("bytes"),
        F.approx_count_distinct("src_ip", 0.01).alias("unique_src_ips"), F.approx_count_distinct("dst_port", 0.01).alias("unique_dst_ports"),
        F.count_if(F.col("tcp_flags").bitwiseAND(F.lit(2)) != 0).alias("syn"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"))
    return grouped.select(
        F.col("w.start").alias("window_start"), "dst_ip", (F.col("packets") / seconds).alias("packet_rate"),
        (F.col("bytes") / seconds).alias("byte_rate"), "unique_src_ips", "unique_dst_ports",
        (F.col("syn") / F.col("packets")).alias("syn_ratio"), (F.col("bytes") / F.col("packets")).alias("avg_packet_size"),
        (F.col("last") - F.col("first")).alias("flow_duration"))


def late_rows(run) -> int:
    """Rows that a finished or running query dropped because they came after the watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in run.recentProgress for op in p.get("stateOperators", []))
