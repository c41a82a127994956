"""Cases that earlier versions got wrong."""

from __future__ import annotations

import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly, behavior, incstats, learn, sampling, similarity, traffic
from tidewatch.operators.scans import BLOCK, with_block, with_value_block
from tidewatch.sources.log_table import LogTable
from tidewatch.sources.streams import drain, file_stream
from tidewatch.streaming import snapshots


def test_smote_of_a_class_smaller_than_its_neighbourhood(spark):
    rows = [(i, 0, float(i), 1.0) for i in range(37)] + [(100 + i, 1, float(i), 2.0) for i in range(3)] + [(200, 2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    out = sampling.balance(df, "label", ["id"], "smote", features=["a", "b"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 37, 1: 37, 2: 37}
    assert out.where("label = 2").select("a", "b").distinct().count() == 1


def test_split_by_any_number_of_classes(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 15_000).alias("kind"))
    marked = sampling.mark_fraction(df, ["id"], fraction=0.5, by="kind")
    assert marked.where("picked").groupBy("kind").count().where("count <> 1").isEmpty() and marked.where("picked").count() == 15_000


def test_retention_keeps_rows_without_a_time(spark, tables, tmp_path):
    log = tables.traffic.limit(200)
    rows = log.withColumn("timestamp", F.when(F.col("id") % 50 != 0, F.col("timestamp")))
    table = LogTable(spark, str(tmp_path / "log"), log.schema)
    table.append(rows)
    kept = table.read().where("timestamp IS NULL").count()
    cutoff = table.read().agg(F.max("timestamp")).first()[0] + dt.timedelta(days=1)
    assert table.delete_before(cutoff) == table_size(rows) - kept and table.read().count() == kept
    assert table.delete_before(cutoff) == 0


def table_size(df):
    return df.count()


def test_totals_without_a_threat(spark):
    rows = spark.createDataFrame([(False, 0.1, [])], "is_threat boolean, threat_score double, threat_types array<string>")
    assert [tuple(r) for r in behavior.detector_statistics(rows).collect()] == [(None, 0, 1, 0, 0.0)]


def test_page_beyond_the_end_keeps_its_total(tables):
    found = traffic.page_with_total(tables.traffic, limit=10, offset=1 << 30).first()
    assert found["total"] == tables.traffic.count() and found["rows"] == []


@pytest.mark.parametrize("make", [
    lambda spark: (spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") < 2, F.col("id") * 1.0).otherwise(1e6 + F.col("id")).alias("t")), "t"),
    lambda spark: (spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 1000).alias("t")), "t")])
def test_blocks_hold_a_bounded_number_of_rows(spark, make):
    df, at = make(spark)
    sizes = [r["count"] for cut in (with_value_block(df, ["k"], F.col(at), 1000), with_block(df, ["k"], at, 1000)) for r in cut.groupBy(BLOCK).count().collect()]
    assert max(sizes) <= 1000 and min(sizes) >= 200 and sum(sizes) == 40_000


def test_blocks_follow_the_order(spark):
    df = spark.range(5_000).select((F.col("id") % 2).alias("k"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("t"))
    spans = with_value_block(df, ["k"], F.col("t"), 300).groupBy("k", BLOCK).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("k", BLOCK).collect()
    assert len(spans) > 10 and all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]) if a["k"] == b["k"])


def test_items_go_only_to_blocks_that_visit_them(spark):
    import random

    rng = random.Random(0)
    points = [(i, [rng.gauss(10 * (i % 20), 0.3), rng.gauss(3 * (i % 7), 0.3)]) for i in range(1200)]
    df = spark.createDataFrame(points, "id long, vec array<double>")
    got = similarity.nearest(df, df, 3, skip_self=True, chunk_rows=100, block_queries=50)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append(round(r["measure"], 6))
    for i, v in points[:100]:
        near = sorted(math.dist(v, w) for j, w in points if j != i)[:3]
        assert sorted(found[i]) == pytest.approx(near, abs=1e-6)


def test_penalty_follows_the_rows():
    assert learn.penalty(10.0, 1000) == 1e-4
    assert learn.vote_weights({"a": 0.5, "b": 1.5}) == {"a": 0.25, "b": 0.75}


def test_label_is_not_given_away(tables):
    rows = tables.phishing
    total = rows.count()
    for c in rows.columns[1:-1]:
        best = rows.groupBy(c).agg(F.count_if(F.col("Result") == 1).alias("p"), F.count_if(F.col("Result") == -1).alias("n"))
        assert best.agg(F.sum(F.greatest("p", "n"))).first()[0] < 0.9 * total


def test_encoders_need_packets(spark):
    rows = incstats.packet_vectors(spark.createDataFrame([], "pkt_no long, ts_s double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packet_size int, tcp_flags int"))
    with pytest.raises(ValueError):
        anomaly.EncoderEnsemble.fit(rows, "pkt_no", "vector")


def test_a_stopped_stream_goes_on(spark, tables, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    plain = str(tmp_path / "plain")
    packets = tables.packets
    top = packets.agg(F.max("pkt_no")).first()[0] + 1
    for i in range(2):
        packets.where((F.col("pkt_no") >= top * i // 2) & (F.col("pkt_no") < top * (i + 1) // 2)).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
        got = snapshots.stream_damped(file_stream(spark, source, packets.schema), ["ip"], folder=state)
        rows = drain(file_stream(spark, source, packets.schema), "rows", folder=plain)
    assert rows.count() == packets.count()
    expected = {r.pkt_no: r.weight_0 for r in incstats.damped_statistics(incstats.channel_rows(packets, ["ip"])).collect()}
    assert {r.pkt_no: r.weight_0 for r in got.collect()} == pytest.approx(expected)


def test_whole_records_survive_a_json_round_trip(tables):
    from tidewatch.plans.streams import log_records
    from tidewatch.schemas import TRAFFIC_LOG
    from tidewatch.sources.log_table import from_json, to_json

    records = log_records(tables.traffic.where("id % 40 < 12"))
    back = from_json(to_json(records))
    assert back.schema.simpleString() == TRAFFIC_LOG.simpleString() and len(back.columns) == 22
    assert {r.id: r.asDict(True) for r in back.collect()} == {r.id: r.asDict(True) for r in records.collect()}
