"""Traffic log reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import traffic as op
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import query

AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)
START = dt.datetime(2024, 1, 10, 0, 0, 0)
TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def text_ts(c: str):
    return F.date_format(c, TS)


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


_COUNT_STRING = """(SELECT string_agg({k} || '=' || CAST(cnt AS VARCHAR), ',' ORDER BY cnt DESC, {k}) FROM
  (SELECT {k}, count(*) AS cnt FROM traffic {where} GROUP BY {k} {limit}))"""


def _counted(k: str, where: str = "", limit: str = "") -> str:
    return _COUNT_STRING.format(k=k, where=where, limit=limit)


@query("traffic_overview", "A1 A2 A3 T1 T2 D7", with_views("traffic", f"""
SELECT count(*) AS total_requests, count(*) FILTER (action='block') AS blocked_requests,
 count(*) FILTER (action='allow') AS allowed_requests, count(*) FILTER (action='challenge') AS challenged_requests,
 round(coalesce(avg(risk_score),0),6) AS avg_risk_score, round(coalesce(avg(processing_time_ms),0),6) AS avg_processing_time_ms,
 {sql_ts('min(timestamp)')} AS time_range_start, {sql_ts('max(timestamp)')} AS time_range_end,
 {_counted('threat_type')} AS threat_type_counts, {_counted('action')} AS action_counts, {_counted('risk_level')} AS risk_level_counts,
 {_counted('source_ip', limit='ORDER BY cnt DESC, source_ip LIMIT 10')} AS top_source_ips,
 {_counted('threat_type', "WHERE threat_type <> 'benign'", 'ORDER BY cnt DESC, threat_type LIMIT 5')} AS top_threat_types
FROM traffic"""))
def traffic_overview(t):
    return (
        op.overview(t.traffic)
        .withColumn("avg_risk_score", F.round("avg_risk_score", 6))
        .withColumn("avg_processing_time_ms", F.round("avg_processing_time_ms", 6))
        .withColumn("time_range_start", text_ts("time_range_start"))
        .withColumn("time_range_end", text_ts("time_range_end"))
    )


@query("traffic_action_counters", "A1 F3", with_views("traffic", """
SELECT count(*) AS total_requests, count(*) FILTER (action='block') AS blocked_requests,
 count(*) FILTER (action='allow') AS allowed_requests, count(*) FILTER (action='challenge') AS challenged_requests,
 round(coalesce(avg(risk_score),0),6) AS avg_risk_score, round(coalesce(avg(processing_time_ms),0),6) AS avg_processing_time_ms
FROM traffic WHERE timestamp BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""))
def traffic_action_counters(t):
    return (
        op.action_counters(op.last_hours(t.traffic, AS_OF, hours=168))
        .withColumn("avg_risk_score", F.round("avg_risk_score", 6))
        .withColumn("avg_processing_time_ms", F.round("avg_processing_time_ms", 6))
    )


@query("traffic_label_counts", "A2", with_views("traffic", """
SELECT 'threat_type' AS dimension, threat_type AS label, count(*) AS cnt FROM traffic GROUP BY threat_type
UNION ALL SELECT 'action', action, count(*) FROM traffic GROUP BY action
UNION ALL SELECT 'risk_level', risk_level, count(*) FROM traffic GROUP BY risk_level"""))
def traffic_label_counts(t):
    return op.label_counts(t.traffic)


@query("threat_type_distribution", "A4", with_views("traffic", "SELECT threat_type, count(*) AS cnt FROM traffic GROUP BY 1"))
def threat_type_distribution(t):
    return op.distribution(t.traffic, "threat_type")


@query("action_distribution", "A5", with_views("traffic", "SELECT action, count(*) AS cnt FROM traffic GROUP BY 1"))
def action_distribution(t):
    return op.distribution(t.traffic, "action")


@query("country_distribution", "A6 D5", with_views("traffic", "SELECT coalesce(geo_country,'Unknown') AS geo_country, count(*) AS cnt FROM traffic GROUP BY 1"))
def country_distribution(t):
    return op.distribution(t.traffic, "geo_country", when_null="Unknown")


_HIST = """SELECT CAST(i AS BIGINT) AS bin, printf('%.1f-%.1f', i*(1e0/{n}), (i+1)*(1e0/{n})) AS label,
 i*(1e0/{n}) AS low, (i+1)*(1e0/{n}) AS high,
 (SELECT count(*) FROM traffic WHERE risk_score >= i*(1e0/{n}) AND (risk_score < (i+1)*(1e0/{n}) {last})) AS cnt
FROM range({n}) r(i)"""


@query("risk_histogram", "A7 F4", with_views("traffic", _HIST.format(n=10, last="OR (i = 9 AND risk_score = 1.0)")))
def risk_histogram(t):
    return op.risk_histogram(t.traffic, bins=10)


@query("risk_histogram_open_top", "A7", with_views("traffic", _HIST.format(n=20, last="")))
def risk_histogram_open_top(t):
    return op.risk_histogram(t.traffic, bins=20, compat=True)


_LINE = """SELECT {ts} AS bucket_start, count(*) AS total, count(*) FILTER (action='block') AS blocked, count(*) FILTER (threat_type<>'benign') AS threats
FROM traffic WHERE timestamp >= TIMESTAMP '2024-01-10' GROUP BY floor((epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-10'))/{step})"""


@query("traffic_timeline", "A8", with_views("traffic", _LINE.format(
    ts=sql_ts("make_timestamp(CAST(epoch_us(TIMESTAMP '2024-01-10') + floor((min(epoch_us(timestamp)) - epoch_us(TIMESTAMP '2024-01-10'))/3600000000)*3600000000 AS BIGINT))"),
    step="3600000000")))
def traffic_timeline(t):
    lines = op.timeline(op.search(t.traffic, start=START), START, interval_minutes=60)
    return lines.withColumn("bucket_start", text_ts("bucket_start"))


@query("filtered_row_count", "A9", with_views("traffic", "SELECT count(*) AS cnt FROM traffic WHERE timestamp >= TIMESTAMP '2024-01-10' AND action='alert'"))
def filtered_row_count(t):
    return op.search(t.traffic, start=START, action="alert").agg(F.count(F.lit(1)).alias("cnt"))


@query("protection_counters", "A10", with_views("traffic", f"""
SELECT count(*) AS total_requests, count(*) FILTER (action='block') AS blocked_requests,
 count(*) - count(*) FILTER (action='block') AS allowed_requests, count(*) FILTER (threat_type<>'benign') AS threats_detected,
 round(100e0*count(*) FILTER (action='block')/greatest(count(*),1),2) AS block_rate,
 {sql_ts("max(timestamp) FILTER (threat_type<>'benign')")} AS last_threat_time FROM traffic"""))
def protection_counters(t):
    return op.protection_counters(t.traffic).withColumn("last_threat_time", text_ts("last_threat_time"))


_LOG = "id, source_ip, threat_type, risk_level, risk_score, action"


@query("log_search", "F1", with_views("traffic", f"""SELECT {_LOG}, {sql_ts('timestamp')} AS ts FROM traffic
WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00' AND threat_type='phishing' AND action='alert'
  AND risk_level='low' AND risk_score >= 0.1"""))
def log_search(t):
    hits = op.search(t.traffic, start=START, end=AS_OF, threat_type="phishing", action="alert",
                     risk_level="low", min_risk_score=0.1)
    return hits.select(*_LOG.split(", "), text_ts("timestamp").alias("ts"))


@query("log_search_by_source", "F1", with_views("traffic", f"SELECT {_LOG} FROM traffic WHERE source_ip='10.0.8.1'"))
def log_search_by_source(t):
    return op.search(t.traffic, source_ip="10.0.8.1").select(*_LOG.split(", "))


@query("log_top_by_score", "F2", with_views("traffic", f"SELECT {_LOG} FROM traffic ORDER BY risk_score DESC, id LIMIT 25"))
def log_top_by_score(t):
    return op.ordered(t.traffic, "risk_score").limit(25).select(*_LOG.split(", "))


@query("last_day_log", "F3", with_views("traffic", f"SELECT {_LOG} FROM traffic WHERE timestamp BETWEEN TIMESTAMP '2024-01-19 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"))
def last_day_log(t):
    return op.last_hours(t.traffic, AS_OF).select(*_LOG.split(", "))


@query("threat_log", "F5", with_views("traffic", f"SELECT {_LOG} FROM traffic WHERE threat_type <> 'benign'"))
def threat_log(t):
    return op.threats_only(t.traffic).select(*_LOG.split(", "))


@query("top_sources", "T1", with_views("traffic", "SELECT source_ip, count(*) AS cnt FROM traffic GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_sources(t):
    return op.top_sources(t.traffic)


@query("top_threat_sources", "T1 F5", with_views("traffic", "SELECT source_ip, count(*) AS cnt FROM traffic WHERE threat_type<>'benign' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_threat_sources(t):
    return op.top_sources(t.traffic, threat_only=True)


@query("top_threat_types", "T2", with_views("traffic", "SELECT threat_type, count(*) AS cnt FROM traffic WHERE threat_type<>'benign' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def top_threat_types(t):
    return op.top_threat_types(t.traffic)


@query("recent_threats", "T3", with_views("traffic", f"SELECT {_LOG}, {sql_ts('timestamp')} AS ts FROM traffic WHERE threat_type<>'benign' ORDER BY timestamp DESC, id LIMIT 20"))
def recent_threats(t):
    return op.recent_threats(t.traffic).select(*_LOG.split(", "), text_ts("timestamp").alias("ts"))


@query("log_page", "T4", with_views("traffic", f"""SELECT {_LOG}, (SELECT count(*) FROM traffic WHERE risk_score>=0.5) AS total
FROM traffic WHERE risk_score>=0.5 ORDER BY timestamp DESC, id LIMIT 50 OFFSET 100"""))
def log_page(t):
    rows = op.page(op.search(t.traffic, min_risk_score=0.5), limit=50, offset=100)
    return rows.select(*_LOG.split(", "), "total")


@query("empty_log_page", "T4", with_views("traffic", "SELECT count(*) AS total, 0 AS returned FROM traffic WHERE risk_score>=0.5"))
def empty_log_page(t):
    beyond = op.page_with_total(op.search(t.traffic, min_risk_score=0.5), limit=50, offset=1 << 30)
    return beyond.select("total", F.size("rows").alias("returned"))


@query("log_page_with_total", "T4", with_views("traffic", f"""SELECT {_LOG}, place, (SELECT count(*) FROM traffic WHERE risk_score>=0.5) AS total
FROM (SELECT *, CAST(row_number() OVER (ORDER BY timestamp DESC, id) - 101 AS INT) AS place FROM traffic WHERE risk_score>=0.5) WHERE place BETWEEN 0 AND 49"""))
def log_page_with_total(t):
    page = op.page_with_total(op.search(t.traffic, min_risk_score=0.5), limit=50, offset=100)
    return page.select("total", F.posexplode("rows").alias("place", "r")).select("total", "place", "r.*").select(*_LOG.split(", "), "place", "total")


@query("log_page_after", "T4", with_views("traffic", f"""SELECT {_LOG} FROM traffic WHERE timestamp < TIMESTAMP '2024-01-20 12:00:00'
 ORDER BY timestamp DESC, id LIMIT 50"""))
def log_page_after(t):
    return op.page_after(t.traffic, AS_OF, 1 << 62).select(*_LOG.split(", "))
