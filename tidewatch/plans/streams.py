"""Streams run over everything available; results equal their batch twins."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import behavior as B
from tidewatch.operators import labels as L
from tidewatch.operators import learn as M
from tidewatch.operators.incstats import CHANNELS
from tidewatch.plans.flows import (
    _FLOW_COLS, _FLOWS, _GREEDY, _MAXS, _REPORTS, _RS, _RUN, _RUN_COLS, _SCOLS, ORDER, flow_contacts, rounded)
from tidewatch.plans.learn import IDS, sample_model, training_rows
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import Tables, query
from tidewatch.plans.traffic import sql_ts, text_ts
from tidewatch.plans.vectors import _ST, _damped, _statistics_columns
from tidewatch.runtime import materialize, shared_dir
from tidewatch.schemas import PHISHING_FEATURES as FEATURES
from tidewatch.schemas import PREDICTION, TRAFFIC_LOG
from tidewatch.sources.log_table import LogTable, decode, from_json, to_json
from tidewatch.sources.streams import drain, drain_updates, file_stream, sink_to_log
from tidewatch.streaming import logs, snapshots, state


class StreamTables(Tables):
    """The same tables, with events and line items read as streams."""

    def __getattr__(self, name):
        if name in ("events", "lineitem"):
            schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
            return file_stream(self.spark, self.sf_dir, schema, f"{name}.parquet")
        return super().__getattr__(name)


def live(t):
    return StreamTables(t.spark, t.sf_dir)


@query("live_timeline", "ST1 S16", with_views("traffic", f"""SELECT {sql_ts("date_trunc('hour', min(timestamp))")} AS bucket_start, count(*) AS total, count(*) FILTER (action='block') AS blocked,
 count(*) FILTER (threat_type<>'benign') AS threats FROM traffic GROUP BY date_trunc('hour', timestamp)"""))
def live_timeline(t):
    return drain_updates(logs.live_timeline(live(t).traffic), "timeline", ["bucket_start"]).withColumn("bucket_start", text_ts("bucket_start"))


@query("live_counters", "ST2", with_views("traffic", f"""SELECT count(*) AS total_requests, count(*) FILTER (action='block') AS blocked_requests, count(*) FILTER (threat_type<>'benign') AS threats_detected,
 {sql_ts("max(timestamp) FILTER (threat_type<>'benign')")} AS last_threat_time FROM traffic"""))
def live_counters(t):
    counters = logs.live_counters(live(t).traffic).withColumn("all_rows", F.lit(1))
    return drain_updates(counters, "counters", ["all_rows"]).drop("all_rows").withColumn("last_threat_time", text_ts("last_threat_time"))


@query("streamed_flows", "ST3 S16", with_views("packets keyed", _FLOWS + """,
ends AS (SELECT flow_key, flow_seq, max(ts_s) AS end_time, bool_or((tcp_flags & 5) <> 0) AS closed, max(flow_seq) OVER (PARTITION BY flow_key) AS last_seq, (SELECT max(ts_s) FROM packets) AS now FROM w4 GROUP BY flow_key, flow_seq)
SELECT """ + ", ".join(f"f.{c}" for c in _FLOW_COLS) + ", round(f.duration, 4) AS duration FROM flow_rows f JOIN ends e USING (flow_key, flow_seq) WHERE closed OR flow_seq < last_seq OR end_time + 60.002 < now"))
def streamed_flows(t):
    flows = drain(state.stream_flows(live(t).packets), "flows")
    return flows.select(*_FLOW_COLS, F.round(F.col("end_time") - F.col("start_time"), 4).alias("duration"))


@query("streamed_flow_samples", "ST4", with_views("packets keyed", _GREEDY.format(n=5, t=60) + """
SELECT flow_key, sample_no, count(*) AS packets, min(pkt_no) AS first_packet, max(pkt_no) AS last_packet FROM sampled GROUP BY 1, 2 HAVING count(*) >= 5 OR max(ts_s) - min(ts_s) >= 60""", recursive=True))
def streamed_flow_samples(t):
    rows = drain(state.stream_samples(live(t).packets, 5, 60.0, idle_flush=3600.0), "samples")
    return rows.select("flow_key", "sample_no", F.col("packets").cast("bigint").alias("packets"), "first_packet", "last_packet")


@query("streamed_damped_statistics", "ST5", with_views("packets", _damped(CHANNELS) + f" SELECT pkt_no, channel, {', '.join(_ST)} FROM ds"))
def streamed_damped_statistics(t):
    return snapshots.stream_damped(live(t).packets, CHANNELS).select("pkt_no", "channel", *_statistics_columns())


@query("streamed_behavior", "ST6", with_views("flows", _RUN + f"SELECT {', '.join(_RUN_COLS)}, {_RS}, round({_MAXS}, 6) AS behavior_score FROM running"))
def streamed_behavior(t):
    rows = drain(state.stream_profiles(flow_contacts(live(t)), ORDER), "profiles")
    return rounded(rows, *_SCOLS, "behavior_score").select(*_RUN_COLS, *_SCOLS, "behavior_score")


@query("streamed_reputation", "ST7", with_views("flows host_lists", _REPORTS + "SELECT ip, round(score, 6) AS score, categories, reports, source FROM rep"))
def streamed_reputation(t):
    scored = state.stream_profiles(flow_contacts(live(t)), ORDER)
    out = snapshots.stream_feedback(scored, B.current_lists(t.host_lists))
    return rounded(out, "score").withColumn("categories", F.concat_ws(",", "categories"))


@query("streamed_scores", "ST8")
def streamed_scores(t):
    fitted = M.make_model("logistic_regression").fit(materialize(training_rows(t), "rows"))
    rows = M.assembled(live(t).phishing, FEATURES, L.zero_one("Result")).select(*IDS, "features", "label")
    return drain(M.score(fitted, rows).select("row_id", "label", "score", "y_pred"), "scores")


@query("streamed_packet_scores", "ST8 M32 M33 M34")
def streamed_packet_scores(t):
    return snapshots.stream_ensemble(live(t).packets)


@query("streamed_sample_scores", "ST8 M35")
def streamed_sample_scores(t):
    fitted = sample_model(t)
    samples = state.stream_samples(live(t).packets, 10, 10.0, idle_flush=3600.0)
    rows = samples.select("flow_key", "sample_no", array_to_vector("matrix").alias("features"))
    return drain(M.score(fitted, rows).select("flow_key", "sample_no", "score", "y_pred"), "sample-scores")


@query("streamed_unique_log", "ST9", with_views("traffic", "SELECT id, source_ip, threat_type, action FROM traffic"))
def streamed_unique_log(t):
    twice = live(t).traffic.unionByName(live(t).traffic)
    return drain(logs.unique_entries(twice).select("id", "source_ip", "threat_type", "action"), "unique")


@query("streamed_security_states", "ST10", with_views("packets", """, sl AS (SELECT p.*, w.w FROM packets p, (SELECT unnest(range(0, 6)) AS o), LATERAL (SELECT CAST(floor(ts_s/10) AS BIGINT)*10 - o*10 AS w) w)
SELECT w AS window_s, dst_ip, round(count(*)/60e0, 6) AS packet_rate, round(sum(packet_size)/60e0, 6) AS byte_rate, round(count(*) FILTER ((tcp_flags & 2) <> 0)*1e0/count(*), 6) AS syn_ratio, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_port) AS unique_dst_ports,
 round(sum(packet_size)*1e0/count(*), 6) AS avg_packet_size, round(max(ts_s) - min(ts_s), 6) AS flow_duration FROM sl GROUP BY 1, 2"""))
def streamed_security_states(t):
    rows = snapshots.stream_security_states(live(t).packets)
    names = ["packet_rate", "byte_rate", "syn_ratio", "avg_packet_size", "flow_duration"]
    return rows.select("window_s", "dst_ip", "unique_src_ips", "unique_dst_ports", *[F.round(n, 6).alias(n) for n in names])


@query("late_event_timeline", "ST11", with_views("traffic", f""", half AS (SELECT max(id) // 2 AS h, max(timestamp) - INTERVAL 1 HOUR AS w FROM traffic)
SELECT {sql_ts("date_trunc('hour', min(timestamp))")} AS bucket_start, count(*) AS total FROM traffic, half WHERE id > h GROUP BY date_trunc('hour', timestamp) HAVING date_trunc('hour', min(timestamp)) + INTERVAL 1 HOUR <= any_value(w)"""))
def late_event_timeline(t):
    """The later half of the log arrives first, in two batches (rows are late by the watermark
    that the batch before started with), so the earlier half is dropped."""
    folder, n = shared_dir(t.spark, "late"), F.col("id")
    half, late = t.traffic.agg(F.floor(F.max("id") / 2), F.floor(F.max("id") * 3 / 4)).first()
    for part in (t.traffic.where((n > half) & (n <= late)), t.traffic.where(n > late), t.traffic.where(n <= half)):
        part.coalesce(1).write.mode("append").parquet(folder)
    lines = logs.live_timeline(file_stream(t.spark, folder, t.traffic.schema), delay="1 hour")
    return drain(lines, "late-lines").select(text_ts("bucket_start").alias("bucket_start"), "total")


# --- the log table --------------------------------------------------------------------------


def _log_schema(t):
    return t.traffic.schema


@query("deduplicated_appends", "S5 S6 J9 S3", with_views("traffic", """SELECT 'first' AS step, count(*) FILTER (risk_score < 0.5) AS cnt FROM traffic
 UNION ALL SELECT 'second', count(*) FILTER (risk_score >= 0.5 OR risk_score IS NULL) FROM traffic UNION ALL SELECT 'stored', count(*) FROM traffic UNION ALL SELECT 'again', 0 FROM traffic WHERE id = 0"""))
def deduplicated_appends(t):
    table = LogTable(t.spark, shared_dir(t.spark, "log"), _log_schema(t))
    low = t.traffic.where("risk_score < 0.5")
    counts = {"first": table.append_new(low.unionByName(low)), "second": table.append_new(t.traffic), "again": table.append_new(t.traffic)}
    stored = table.read().agg(F.lit("stored").alias("step"), F.count(F.lit(1)).alias("cnt"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(v).cast("bigint").alias("cnt")) for k, v in counts.items()]))
    return stored.unionByName(table.read().agg(F.count(F.lit(1))).select(steps.alias("s")).select("s.*"))


@query("log_lookup", "S7", with_views("traffic", "SELECT id, source_ip, action, risk_score FROM traffic WHERE id = 777"))
def log_lookup(t):
    table = LogTable(t.spark, shared_dir(t.spark, "log"), _log_schema(t))
    table.append(t.traffic)
    return table.get(777).select("id", "source_ip", "action", "risk_score")


@query("retention_delete", "S8", with_views("traffic", "SELECT count(*) FILTER (timestamp < TIMESTAMP '2024-01-12 06:00:00') AS deleted, count(*) FILTER (timestamp >= TIMESTAMP '2024-01-12 06:00:00') AS left_rows FROM traffic"))
def retention_delete(t):
    import datetime as dt

    table = LogTable(t.spark, shared_dir(t.spark, "log"), _log_schema(t))
    table.append(t.traffic)
    gone = table.delete_before(dt.datetime(2024, 1, 12, 6))
    return table.read().agg(F.lit(gone).cast("bigint").alias("deleted"), F.count(F.lit(1)).alias("left_rows"))


@query("cleared_log", "S9", with_views("traffic", "SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS left_rows FROM traffic"))
def cleared_log(t):
    table = LogTable(t.spark, shared_dir(t.spark, "log"), _log_schema(t))
    table.append(t.traffic)
    gone = table.clear()
    return table.read().agg(F.lit(gone).cast("bigint").alias("deleted"), F.count(F.lit(1)).alias("left_rows"))


@query("streamed_log_sink", "S17 ST9", with_views("traffic", "SELECT count(*) AS cnt, count(DISTINCT id) AS ids FROM traffic"))
def streamed_log_sink(t):
    table = LogTable(t.spark, shared_dir(t.spark, "log"), _log_schema(t))
    for _ in range(2):  # a second full delivery must not add rows
        sink_to_log(live(t).traffic, table, shared_dir(t.spark, "log-state")).awaitTermination()
    return table.read().agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("id").alias("ids"))


_JLOG = "id, source_ip, dest_port, threat_type, risk_level, risk_score, action"


@query("log_json_round_trip", "S10 D1 D3 D4", with_views("traffic", f"SELECT {_JLOG}, {sql_ts('timestamp')} AS ts FROM traffic"))
def log_json_round_trip(t):
    rows = t.traffic
    back = from_json(to_json(rows), rows.schema)
    return back.select(*_JLOG.split(", "), text_ts("timestamp").alias("ts"))


_RECORD = {  # flat column of the round trip: how SQL says it
    "id": "CAST(id AS VARCHAR)", "source_ip": "source_ip", "dest_port": "dest_port", "threat_type": "threat_type", "risk_level": "risk_level", "action": "action", "risk_score": "risk_score",
    "url": "'/a?q=\"' || id || '\"'", "user_agent": "CASE WHEN id % 4 = 0 THEN NULL ELSE 'é' || chr(10) || 'x' END", "n_predictions": "CASE WHEN id % 3 = 0 THEN 0 ELSE 2 END",
    "model_1": "CASE WHEN id % 3 <> 0 THEN 'm1' END", "score_1": "CASE WHEN id % 3 <> 0 THEN risk_score END", "prediction_2": "CASE WHEN id % 3 <> 0 THEN 1 END", "confidence_2": "CAST(NULL AS DOUBLE)",
    "country": "geo_country", "latitude": "CASE WHEN geo_country IS NOT NULL THEN 1.5e0 END", "feature_a": "CAST(id % 7 AS VARCHAR)", "feature_b": "CAST(NULL AS VARCHAR)",
    "n_metadata": "CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END", "captcha_required": "id % 2 = 0", "captcha_passed": "CASE WHEN id % 6 = 0 THEN true END", "processing_time_ms": "processing_time_ms"}


def log_records(rows):
    """Whole records of 22 fields, nested parts and nulls included, from the flat log."""
    n, none = F.col("id"), lambda kind: F.lit(None).cast(kind)
    made = {
        "id": n.cast("string"), "url": F.concat(F.lit('/a?q="'), n.cast("string"), F.lit('"')), "user_agent": F.when(n % 4 != 0, F.lit("é\nx")),
        "predictions": F.when(n % 3 == 0, F.array().cast(T.ArrayType(PREDICTION))).otherwise(F.array(
            F.struct(F.lit("m1").alias("model_name"), F.lit("tree").alias("model_type"), F.col("risk_score").alias("score"), F.lit(0).alias("prediction"), F.lit(0.25).alias("confidence"), F.lit(0.5).alias("inference_time_ms")),
            F.struct(F.lit("m2").alias("model_name"), none("string").alias("model_type"), F.lit(0.5).alias("score"), F.lit(1).alias("prediction"), none("double").alias("confidence"), F.lit(1.0).alias("inference_time_ms")))
            .cast(T.ArrayType(PREDICTION))),
        "geo_location": F.when(F.col("geo_country").isNotNull(), F.struct(F.col("geo_country").alias("country"), F.lit("XX").alias("country_code"), none("string").alias("city"),
                                                                          F.lit(1.5).alias("latitude"), F.lit(-2.25).alias("longitude"))),
        "features": F.create_map(F.lit("a"), (n % 7).cast("string"), F.lit("c"), F.lit('{"x": [1]}')),
        "metadata": F.when(n % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("k"), F.lit("v"))),
        "captcha_required": n % 2 == 0, "captcha_passed": F.when(n % 6 == 0, F.lit(True))}
    return rows.select(*[made.get(f.name, F.col(f.name) if f.name in rows.columns else none(f.dataType)).cast(f.dataType).alias(f.name) for f in TRAFFIC_LOG.fields])


@query("log_record_round_trip", "S10 D1 D3 D4", with_views("traffic", "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _RECORD.items()) + f", {sql_ts('timestamp')} AS ts FROM traffic"))
def log_record_round_trip(t):
    back = from_json(to_json(log_records(t.traffic)))
    first, second = (F.get("predictions", F.lit(i)) for i in (0, 1))
    nested = {"n_predictions": F.size("predictions"), "model_1": first["model_name"], "score_1": first["score"], "prediction_2": second["prediction"], "confidence_2": second["confidence"],
              "country": F.col("geo_location.country"), "latitude": F.col("geo_location.latitude"), "feature_a": F.try_element_at("features", F.lit("a")),
              "feature_b": F.try_element_at("features", F.lit("b")), "n_metadata": F.size("metadata")}
    return back.select(*[nested.get(c, F.col(c)).alias(c) for c in _RECORD], text_ts("timestamp").alias("ts"))


@query("decoded_log_rows", "S11 D2 D5 D6", with_views("traffic", """SELECT id, coalesce(CASE WHEN id % 3 <> 0 THEN source_ip END, '') AS source_ip, coalesce(CASE WHEN id % 4 <> 0 THEN risk_score END, 0) AS risk_score,
 coalesce(CASE WHEN id % 5 <> 0 THEN threat_type END, 'benign') AS threat_type, 'HTTP' AS protocol, geo_country AS country, CASE WHEN geo_country IS NOT NULL THEN 'Unknown' END AS city,
 CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_predictions, CASE WHEN id % 2 = 0 THEN risk_score END AS first_score FROM traffic"""))
def decoded_log_rows(t):
    n = F.col("id")
    stored = t.traffic.select(
        "id", F.when(n % 3 != 0, F.col("source_ip")).alias("source_ip"), F.when(n % 4 != 0, F.col("risk_score")).alias("risk_score"),
        F.when(n % 5 != 0, F.col("threat_type")).alias("threat_type"), F.lit(None).cast("string").alias("protocol"), "geo_country",
        F.when(n % 2 == 0, F.concat(F.lit('[{"model_name":"m","score":'), F.col("risk_score").cast("string"), F.lit("}]"))).alias("predictions"))
    rows = decode(stored)
    return rows.select("id", "source_ip", "risk_score", "threat_type", "protocol", F.col("geo_location.country").alias("country"), F.col("geo_location.city").alias("city"),
                       F.size("predictions").alias("n_predictions"), F.get("predictions", F.lit(0))["score"].alias("first_score"))


@query("feature_file_round_trip", "S1 S2", with_views("phishing", "SELECT row_id, " + ", ".join(f'"{c}"' for c in [*FEATURES, "Result"]) + " FROM phishing"))
def feature_file_round_trip(t):
    from tidewatch.schemas import PHISHING
    from tidewatch.sources.readers import read_features, read_first_available

    path = shared_dir(t.spark, "features")
    t.phishing.write.option("header", True).option("nullValue", "na").csv(path)
    schema = T.StructType([T.StructField("row_id", T.LongType()), *PHISHING.fields])
    options = {"path": path, "schema": schema, "header": True, "nullValue": "na"}
    found = read_first_available(t.spark, [("parquet", {"path": path + "-absent"}), ("csv", options)])
    assert found.columns == read_features(t.spark, path, schema).columns
    return found


@query("connection_file_counts", "S12 D17", "SELECT l_returnflag AS flag, count(*) AS cnt FROM lineitem GROUP BY 1")
def connection_file_counts(t):
    from tidewatch.plans.vectors import connection_rows
    from tidewatch.schemas import KDD_FEATURES
    from tidewatch.sources.readers import read_connections

    path = shared_dir(t.spark, "connections")
    connection_rows(t).select(*KDD_FEATURES, "attack_type", F.lit(1).alias("difficulty")).write.csv(path)
    rows = read_connections(t.spark, path)
    flag = F.when(F.col("protocol_type") == "udp", "A").when(F.col("protocol_type") == "icmp", "R").otherwise("N")
    return rows.groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("cnt"))


@query("scored_feature_file", "S13 S14")
def scored_feature_file(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from tidewatch.schemas import PHISHING
    from tidewatch.sources.readers import save_model, score_file

    rows = t.phishing.drop("row_id").fillna(0)
    source, model, target = (shared_dir(t.spark, n) for n in ("in", "model", "out"))
    rows.write.option("header", True).csv(source)
    training = rows.withColumn("label", L.zero_one("Result").cast("double"))
    save_model(Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), M.make_model("decision_tree", depth=5)]).fit(training), model)
    return score_file(t.spark, source, model, target, PHISHING)
