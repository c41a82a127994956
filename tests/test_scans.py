"""Hot keys: results do not depend on how a key is cut into blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import behavior as B
from tidewatch.operators import flows as O
from tidewatch.operators import incstats as I
from tidewatch.operators import policy as P
from tidewatch.operators import sampling as S
from tidewatch.operators import similarity as N
from tidewatch.operators.scans import order_statistics, with_block, with_value_block

WHOLE, CUT = 1 << 40, 7


def rows_of(df, *keys, digits=9):
    def clean(v):
        if isinstance(v, float):
            return round(v, digits) + 0.0
        return tuple(clean(x) for x in v) if isinstance(v, (list, tuple)) else v

    cols = sorted(df.columns)
    return sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark, tables):
    """Packets of which a third belong to one flow."""
    third = F.col("pkt_no") % 3 == 0
    return tables.packets.withColumns({
        "src_ip": F.when(third, "10.9.9.9").otherwise(F.col("src_ip")), "dst_ip": F.when(third, "172.16.9.9").otherwise(F.col("dst_ip")),
        "src_port": F.when(third, 1234).otherwise(F.col("src_port")), "dst_port": F.when(third, 80).otherwise(F.col("dst_port")),
        "protocol": F.when(third, 6).otherwise(F.col("protocol"))}).cache()


def test_flows(hot):
    assert rows_of(O.flow_table(hot, block_rows=CUT)) == rows_of(O.flow_table(hot, block_rows=WHOLE))


def test_directions(hot):
    cut, whole = (O.with_direction(O.assemble(hot, block_rows=b)).drop("_blk") for b in (CUT, WHOLE))
    assert rows_of(cut) == rows_of(whole)


@pytest.mark.parametrize(("size", "span"), [(5, 60.0), (10, 10.0), (4, 1.0)])
def test_samples(hot, size, span):
    cut, whole = (O.assign_samples(hot, size, span, b).select("pkt_no", "sample_no") for b in (CUT, WHOLE))
    assert rows_of(cut) == rows_of(whole)
    # a direct greedy pass over each flow
    expected, state = {}, {}
    for p in O.keyed(hot).orderBy("pkt_no").collect():
        held, start, number = state.get(p.flow_key, (0, 0.0, 0))
        start = p.ts_s if held == 0 else start
        expected[p.pkt_no] = number
        held += 1
        state[p.flow_key] = (0, 0.0, number + 1) if held >= size or p.ts_s - start >= span else (held, start, number)
    assert {r.pkt_no: r.sample_no for r in whole.collect()} == expected


def test_damped(hot):
    rows = I.channel_rows(hot, ["mac", "ip"])
    cut, whole = (I.damped_statistics(rows, block_rows=b) for b in (CUT, WHOLE))
    names = [c for c in cut.columns if c.startswith(("weight", "mean"))]
    assert rows_of(cut.select("pkt_no", "channel", *names), digits=7) == rows_of(whole.select("pkt_no", "channel", *names), digits=7)


def test_damped_out_of_order(hot):
    late = hot.withColumn("ts_s", F.when(F.col("pkt_no") % 5 == 0, F.col("ts_s") - 3).otherwise(F.col("ts_s")))
    rows = I.channel_rows(late, ["ip"])
    cut = {r.pkt_no: r.weight_0 for r in I.damped_statistics(rows, [0.2], CUT).collect()}
    state = {}
    for r in rows.orderBy("pkt_no").collect():
        w, last = state.get(r.key, (0.0, r.ts_s))
        if r.ts_s > last:
            w, last = w * np.exp(-0.2 * (r.ts_s - last)), r.ts_s
        state[r.key] = (w + 1, last)
        assert cut[r.pkt_no] == pytest.approx(w + 1, rel=1e-9)


def test_running_profiles(hot):
    contacts = B.as_contacts(hot, F.col("ts_s"), "packet_size")
    cut, whole = (B.running_profiles(with_block(contacts, ["src_ip"], "pkt_no", b), ["pkt_no"]).drop("_blk") for b in (CUT, WHOLE))
    timed = B.running_profiles(with_value_block(contacts, ["src_ip"], F.col("ts_s"), CUT), ["ts_s", "pkt_no"]).drop("_blk")
    assert rows_of(cut) == rows_of(whole) == rows_of(timed)


def test_last_running_profile_is_the_profile(hot):
    contacts = B.as_contacts(hot, F.col("ts_s"), "packet_size")
    run = B.running_profiles(with_block(contacts, ["src_ip"], "pkt_no", CUT), ["pkt_no"])
    names = ["total_flows", "unique_dst_ports", "unique_dst_ips", "unique_src_ports", "active_hours", "tcp_flows"]
    last = run.groupBy("src_ip").agg(*[F.max_by(n, "pkt_no").alias(n) for n in names])
    assert rows_of(last) == rows_of(B.profiles(contacts).select("src_ip", *names))


def test_streaks_and_rewards(tables):
    cut, whole = (P.shaped_rewards(tables.decisions, b).select("seq", "streak", "reward", "total_reward") for b in (CUT, WHOLE))
    assert rows_of(cut) == rows_of(whole)


def test_order_statistics_with_outlier(spark):
    values = [float(i % 97) for i in range(1000)] + [1e18, -1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = order_statistics(df, "v", {"a": F.lit(0), "b": F.floor(F.col("n") * 0.5), "c": F.col("n") - 1}, buckets=16, levels=3).first()
    ranked = sorted(values)
    assert (got.a, got.b, got.c) == (ranked[0], ranked[501], ranked[-1])


def test_split_is_exact_and_repeatable(tables):
    train, test = S.split(tables.phishing, ["row_id"])
    ids = {r.row_id for r in test.select("row_id").collect()}
    assert len(ids) == 200 and train.count() == 800 and train.where(F.col("row_id").isin(list(ids))).isEmpty()
    again = S.split(tables.phishing.repartition(7), ["row_id"])[1]
    assert ids == {r.row_id for r in again.select("row_id").collect()}


def test_sample_larger_than_table(tables):
    assert S.sample(tables.phishing, ["row_id"], 10**6).count() == 1000


@pytest.mark.parametrize("metric", ["euclidean", "inner"])
def test_nearest_against_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) + np.repeat(rng.normal(size=(6, 8)) * 8, 50, axis=0)
    x[:100] = x[0]  # a third of the items are copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = N.nearest(df, df, 4, metric=metric, skip_self=True, pivots=8, chunk_rows=20, block_queries=50)
    score = x @ x.T if metric == "inner" else np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    score = np.round(score, 9)
    for q, rows in got.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("l")).collect():
        order = sorted((j for j in range(300) if j != q), key=lambda j: (-score[q, j] if metric == "inner" else score[q, j], j))
        assert [r.item_id for r in rows] == order[:4]


def test_balance(spark):
    df = spark.createDataFrame([(i, int(i >= 90), float(i % 7), float(i % 5)) for i in range(100)], "id long, y int, a double, b double")
    sizes = {s: sorted(r["count"] for r in S.balance(df, "y", ["id"], s, features=["a", "b"], neighbours=3).groupBy("y").count().collect()) for s in S.STRATEGIES}
    assert sizes == {"none": [10, 90], "undersample": [10, 10], "oversample": [90, 90], "smote": [90, 90]}


def test_encoder_training_equals_one_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    x[:, 1], x[:, 4] = x[:, 0] * 2, x[:, 3] + 0.1 * x[:, 4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "no long, v array<double>")
    model = A.EncoderEnsemble.fit(df, "no", "v", map_rows=20, train_rows=30)
    mean, std = x[:20].mean(0), x[:20].std(0)
    members = [A.TinyEncoder(len(g), 0.75, 0.1, 42 + i, mean[g], std[g]) for i, g in enumerate(model.groups)]
    output = A.TinyEncoder(len(members), 0.75, 0.1, 41)
    errors = output.learn(np.column_stack([m.learn(x[20:50][:, g]) for m, g in zip(members, model.groups)]))
    assert model.threshold == pytest.approx(np.percentile(errors, 99))
    scored = model.score(df, "v", "no", 50).where("no >= 50").orderBy("no").collect()
    inner = np.column_stack([m.errors(x[50:, g]) for m, g in zip(members, model.groups)])
    assert [r.rmse for r in scored] == pytest.approx(list(output.errors(inner)))


def test_isolation_forest_finds_the_outlier(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, [float(i % 10), float(i % 7)]) for i in range(400)] + [(999, [90.0, -80.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("f", array_to_vector("v"))
    scored = A.IsolationForest.fit(df, "f", ["id"], trees=30).score(df, "f")
    assert scored.orderBy("anomaly_score").first().id == 999
