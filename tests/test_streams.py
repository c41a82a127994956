"""Streams over several micro-batches: state carries over and late rows are dropped."""

from __future__ import annotations

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import behavior as B
from tidewatch.operators import flows as O
from tidewatch.operators import incstats as I
from tidewatch.operators import learn as M
from tidewatch.operators.scans import with_block
from tidewatch.runtime import materialize
from tidewatch.sources.log_table import LogTable
from tidewatch.sources.streams import drain, file_stream
from tidewatch.streaming import logs, snapshots, state


def in_pieces(spark, df, folder, order, pieces=3):
    """Write a table as several files in arrival order; one file is one micro-batch."""
    top = df.agg(F.max(order)).first()[0] + 1
    for i in range(pieces):
        part = df.where((F.col(order) >= top * i // pieces) & (F.col(order) < top * (i + 1) // pieces))
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # file order follows modification time
    return file_stream(spark, folder, df.schema, "*.parquet")


@pytest.fixture(scope="module")
def pieces(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("packets") / "in")
    in_pieces(spark, tables.packets, folder, "pkt_no")
    return lambda: file_stream(spark, folder, tables.packets.schema)


def test_flows_over_batches(pieces, tables):
    got = drain(state.stream_flows(pieces()), "flows")
    names = ["flow_key", "flow_seq", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "fin_count"]
    batch = O.flow_table(tables.packets).select(*names)
    finished = got.select(*names)
    assert finished.count() == finished.dropDuplicates(["flow_key", "flow_seq"]).count() > 0
    assert finished.exceptAll(batch).isEmpty()


def test_samples_over_batches(pieces, tables):
    got = drain(state.stream_samples(pieces(), 5, 60.0, idle_flush=3600.0), "samples")
    batch = O.sample_matrices(O.assign_samples(tables.packets, 5, 60.0), 5)
    closed = batch.where("packets = 5 OR end_time - start_time >= 60")
    rounded = [F.transform(F.flatten("matrix") if d is closed else F.col("matrix"), lambda x: F.round(x, 9)).alias("m") for d in (got, closed)]
    a = got.select("flow_key", "sample_no", rounded[0])
    b = closed.select("flow_key", "sample_no", rounded[1])
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_samples_of_many_keys_share_their_trips_to_the_state():
    """A bucket's keys are loaded and saved at once, an open sample goes on in the next batch and is flushed when it is due."""
    class Held:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), set()

        def getValueState(self, *_):
            return self.held

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 30_000

        def getExpiryTimeInMs(self):
            return 11_001

    def packets(first, *stamps):
        return pd.DataFrame([(k, first + i * 10 + j, t, [float(j + 1)] * 10) for i, k in enumerate(("a", "b", None)) for j, t in enumerate(stamps)],
                            columns=["flow_key", "pkt_no", "ts_s", "f"])

    handle, cut = Handle(), state._Samples(3, 5.0, 10.0)
    cut.init(handle)
    (one,) = cut.handleInputRows((7,), iter([packets(0, 0.0, 0.5, 0.75, 1.0)]), Clock())
    assert handle.held.calls == 2 and len(one) == 3 and set(one["packets"]) == {3} and handle.timers == {11_001}
    assert one["matrix"].iloc[0].tolist()[11:14] == [2.0, 0.5, 2.0]
    (two,) = cut.handleInputRows((7,), iter([packets(100, 9.0).iloc[:1]]), Clock())  # a's open packet and the one that is late
    assert two[["flow_key", "sample_no", "packets", "first_packet", "last_packet"]].values.tolist() == [["a", 1, 2, 3, 100]]
    (three,) = cut.handleExpiredTimer((7,), Clock(), Clock())
    assert sorted(three["first_packet"]) == [13, 23] and set(three["sample_no"]) == {1} and handle.timers == set()
    (four,) = cut.handleInputRows((7,), iter([packets(200, 40.0)]), Clock())
    assert len(four) == 0 and list(handle.held.value[1]) == [2, 2, 2] and handle.timers == {50_001}


def test_damped_over_batches(pieces, tables):
    got = {r.pkt_no: r for r in snapshots.stream_damped(pieces(), ["ip"]).collect()}
    for r in I.damped_statistics(I.channel_rows(tables.packets, ["ip"])).collect():
        assert got[r.pkt_no].weight_0 == pytest.approx(r.weight_0) and got[r.pkt_no].mean_3 == pytest.approx(r.mean_3)


def test_damped_batches_scan_their_rows_once(pieces, spark, monkeypatch):
    """The next state comes from the written sums and not from a second scan; every key keeps its newest state."""
    scans, scanner = [], I._scanner
    monkeypatch.setattr(I, "_scanner", lambda groups, *rest: scans.append(len(groups)) or scanner(groups, *rest))
    rows = I.channel_rows(spark.createDataFrame([(0, 0.0, 5, "a"), (1, 1.0, 7, "b"), (2, 2.0, 9, "a")], "pkt_no long, ts_s double, packet_size int, src_ip string")
                          .selectExpr("*", "src_ip AS dst_ip", "1 AS src_port", "2 AS dst_port"), ["ip"])
    stepped = materialize(I.damped_step(rows.where("pkt_no < 2"), I.statistic_sums()), "stepped")
    first = materialize(I.state_after(stepped, I.statistic_sums()), "state")
    later = materialize(I.damped_step(rows.where("pkt_no = 2"), I.statistic_sums(), before=first), "stepped")
    second = {r.key: r for r in I.state_after(later, I.statistic_sums(), before=first).collect()}
    assert (second["b"].tau, second["b"].s0) == (1.0, 1.0) and second["a"].tau == 2.0
    whole = {r.key: r for r in I.state_after(I.damped_step(rows, I.statistic_sums()), I.statistic_sums()).collect()}
    assert all(second[k][i] == pytest.approx(whole[k][i]) for k in whole for i in range(2, len(whole[k])))
    scans.clear()
    assert snapshots.stream_damped(pieces(), ["ip"]).count() > 0
    # a batch makes the scan of its rows, that of hot keys and the chain of their blocks, and no others
    assert len(scans) <= 3 * 3


def test_packet_scores_over_batches_and_restarts(spark, tables, tmp_path):
    """Pieces, a stop in the training range and one after it: the batch run's scores."""
    whole = materialize(I.packet_vectors(tables.packets), "vectors")
    model = A.EncoderEnsemble.fit(whole, "pkt_no", "vector", 150, 350)
    want = {r.pkt_no: r for r in model.score(whole, "vector", "pkt_no", 500).collect()}
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    got = []
    for low, high in ((0, 120), (120, 400), (400, 730), (730, 1000)):
        tables.packets.where((F.col("pkt_no") >= low) & (F.col("pkt_no") < high)).coalesce(1).write.mode("append").parquet(source)
        got = snapshots.stream_ensemble(file_stream(spark, source, tables.packets.schema), 150, 350, folder=folder).collect()
        assert len(got) == high
    assert sum(r.is_training for r in got) == 500
    for r in got:
        assert (r.is_training, r.label) == (want[r.pkt_no].is_training, want[r.pkt_no].label)
        assert r.rmse == pytest.approx(want[r.pkt_no].rmse, rel=1e-6) and r.probability == pytest.approx(want[r.pkt_no].probability, rel=1e-6)


def test_saved_ensemble_scores_alike(spark, tables, tmp_path):
    rows = materialize(I.packet_vectors(tables.packets), "vectors")
    model = A.EncoderEnsemble.fit(rows, "pkt_no", "vector", 100, 200)
    model.save(spark, str(tmp_path / "model"))
    again = A.EncoderEnsemble.load(spark, str(tmp_path / "model"))
    assert model.score(rows, "vector").select("pkt_no", "rmse", "label").exceptAll(again.score(rows, "vector").select("pkt_no", "rmse", "label")).isEmpty()


def test_sample_scores_over_batches(pieces, tables):
    rows = O.sample_matrices(O.assign_samples(tables.packets, 5, 60.0), 5, victims=tables.spark.sql("SELECT '172.16.0.2' AS ip"))
    rows = rows.select("flow_key", "sample_no", "packets", "start_time", "end_time", array_to_vector(F.flatten("matrix")).alias("features"), F.col("label").cast("double").alias("label"))
    fitted = M.make_model("logistic_regression").fit(rows)
    stream = state.stream_samples(pieces(), 5, 60.0, idle_flush=3600.0).select("flow_key", "sample_no", array_to_vector("matrix").alias("features"))
    got = {(r.flow_key, r.sample_no): r.score for r in drain(M.score(fitted, stream), "sample-scores").collect()}
    want = {(r.flow_key, r.sample_no): r.score for r in M.score(fitted, rows.where("packets = 5 OR end_time - start_time >= 60")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want) and want


def test_security_states_over_batches_and_restarts(spark, tables, tmp_path):
    """Windows that several batches fill, each value counted once, and packets for ended windows."""
    rows = [(float(ts), "t" if i % 3 else "u", f"s{i % 7}" if i % 5 else None, i % 4, 100 + i, 2 if i % 2 else 16) for i, ts in enumerate([*range(0, 200, 3), 195, 150, 20, 260, 261, 205])]
    schema = "ts_s double, dst_ip string, src_ip string, dst_port int, packet_size int, tcp_flags int"
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    kept, newest, got = {}, float("-inf"), []
    for part in (rows[:20], rows[20:50], rows[50:69], rows[69:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = snapshots.stream_security_states(file_stream(spark, source, spark.createDataFrame(rows, schema).schema), folder=folder).collect()
        for ts, dst, src, port, size, flags in part:
            slot = int(ts // 10 * 10)
            for w in range(slot - 50, slot + 1, 10):
                if w + 60 > newest - 10:
                    kept.setdefault((w, dst), []).append((ts, src, port, size, flags))
        newest = max(newest, *(r[0] for r in part))
    want = {k: (len(v) / 60, len({x[1] for x in v} - {None}), len({x[2] for x in v}), sum(bool(x[4] & 2) for x in v) / len(v), max(x[0] for x in v) - min(x[0] for x in v)) for k, v in kept.items()}
    mine = {(r.window_s, r.dst_ip): (r.packet_rate, r.unique_src_ips, r.unique_dst_ports, r.syn_ratio, r.flow_duration) for r in got}
    assert mine.keys() == want.keys() and len(got) == len(mine)
    assert all(mine[k] == pytest.approx(want[k]) for k in want)


def test_profiles_over_batches(pieces, tables):
    def contacts(packets):
        return B.as_contacts(packets, F.col("ts_s"), "packet_size")

    names = ["pkt_no", "total_flows", "bytes_sent", "unique_dst_ports", "unique_dst_ips", "unique_src_ports", "active_hours", "behavior_score"]
    got = drain(state.stream_profiles(contacts(pieces()), ["pkt_no"]), "profiles").select(*names)
    batch = B.running_profiles(with_block(contacts(tables.packets), ["src_ip"], "pkt_no"), ["pkt_no"]).select(*names)
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    base, folder = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    def rows(hours):
        return spark.createDataFrame([(i, base + dt.timedelta(hours=h), "block", "dos") for i, h in enumerate(hours)],
                                     "id long, timestamp timestamp, action string, threat_type string")
    for hours in ([10, 11, 12], [20], [1, 2, 21]):
        rows(hours).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = logs.live_timeline(file_stream(spark, folder, rows([0]).schema), "60 minutes", delay="2 hours")
    run = stream.writeStream.outputMode("append").format("memory").queryName("late").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert logs.late_rows(run) == 2
    assert {r.bucket_start.hour for r in spark.table("late").collect()} == {10, 11, 12}


def test_log_table(spark, tmp_path):
    now = dt.datetime(2024, 3, 31, 12)
    rows = [(str(i), now - dt.timedelta(days=40), 0.5) for i in range(5)] + [(str(i), now, 0.7) for i in range(5, 8)]
    log = spark.createDataFrame(rows, "id string, timestamp timestamp, risk_score double")
    table = LogTable(spark, str(tmp_path / "log"), log.schema)
    assert table.append_new(log.unionByName(log)) == 8 and table.append_new(log) == 0
    assert table.get("6").count() == 1 and table.get("nope").isEmpty()
    assert table.delete_before(now - dt.timedelta(days=30)) == 5 and table.read().count() == 3
    assert table.delete_before(now) == 0  # strictly older only
    assert table.clear() == 3 and table.read().isEmpty()


def test_lookups_open_only_files_that_may_hold_the_id(spark, tmp_path):
    day = dt.datetime(2024, 3, 1, 12)
    schema = "id string, timestamp timestamp, risk_score double"
    table = LogTable(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema)
    part = lambda d: spark.createDataFrame([(f"{d}-{i}", day + dt.timedelta(days=d), 0.5) for i in range(200)], schema).coalesce(1)
    assert table.files() == [] and table.get("0-1").isEmpty()
    for d in range(12):
        assert table.append_new(part(d)) == 200
    assert len(table.files()) == 12
    opened = [len(table.files_of(f"{d}-{i}")) for d in range(12) for i in (0, 77)]
    assert min(opened) >= 1 and sum(opened) <= 28  # one each, and few false hits
    assert sum(len(table.files_of(f"none-{i}")) for i in range(20)) <= 3
    assert [r.id for r in table.get("5-77").collect()] == ["5-77"]
    assert table.files_of("5-77", day, day + dt.timedelta(days=2)) == [] or table.get("5-77", day, day + dt.timedelta(days=2)).isEmpty()
    again = part(3).union(spark.createDataFrame([("new", day, 0.1)], schema))
    assert table.append_new(again) == 1 and table.append_new(again) == 0
    # a rewritten day, files without a filter and entries of files that are gone
    table.delete_before(day + dt.timedelta(days=2))
    assert table.get("0-1").isEmpty() and table.get("2-5").count() == 1
    part(20).withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(table.path)
    assert table.get("20-9").count() == 1 and table.append_new(part(20)) == 0
    table.append(part(21))
    assert len(table.files_of("20-9")) <= 2 and table.clear() == 200 * 12 and table.read().isEmpty()
