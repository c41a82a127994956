"""Data-parallel gradient steps against one process, gradients against differences, kernels against exact ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tidewatch.operators import gradients as G
from tidewatch.operators import kernels as K


def table(spark, x, y):
    df = spark.createDataFrame([(k, [float(v) for v in r], float(t)) for k, (r, t) in enumerate(zip(x, y))], "id long, a array<double>, label double")
    return df.withColumn("features", array_to_vector("a")).drop("a").repartition(5)


NETS = [G.Encoder(6, (4, 2), np.full(6, 0.3), np.full(6, 1.5)), G.SampleNet(4, 3, filters=5, reach=2)]


@pytest.mark.parametrize("net, width", [(NETS[0], 6), (NETS[1], 12)])
def test_gradients_equal_differences(net, width):
    rng = np.random.default_rng(2)
    x, y, flat = rng.normal(size=(7, width)), rng.integers(0, 2, 7).astype(float), net.start(3) + rng.normal(0, 0.1, len(net.start(3)))
    grad, step = net.loss(flat, x, y)[1], 1e-6
    for k in range(len(flat)):
        move = np.zeros(len(flat))
        move[k] = step
        assert abs((net.loss(flat + move, x, y)[0] - net.loss(flat - move, x, y)[0]) / (2 * step) - grad[k]) < 1e-4


def test_steps_equal_those_of_one_process(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 12)), rng.integers(0, 2, 60).astype(float)
    df, net = table(spark, x, y), NETS[1]
    monkeypatch.setattr(G, "SUMS", 2)  # sums of sums
    rows = df.select(G.vector_to_array("features").alias("x"), df.label.alias("y"))
    n, total, grad = G.gradient(rows, net, net.start(1))
    loss, plain = net.loss(net.start(1), x, y)
    assert n == 60 and abs(total - loss) < 1e-9 and np.allclose(grad, plain)
    flat, losses = G.train(df, net, label="label", steps=4, rate=0.05, seed=1)
    assert len(losses) == 4 and losses[-1] < losses[0] and abs(losses[0] - loss / 60) < 1e-9
    same, _ = G.train(df.repartition(2), net, label="label", steps=4, rate=0.05, seed=1)
    assert np.allclose(flat, same, atol=1e-6)
    assert G.train(df.limit(0), net, label="label", steps=2, seed=1)[1] == []


def test_encoder_finds_what_lies_off_a_curve(spark):
    rng = np.random.default_rng(6)
    t = rng.uniform(-2, 2, 300)
    x = np.c_[t, np.sin(2 * t), t * t]
    odd = np.array([[0.0, 0.0, 4.0], [1.5, -1.5, 0.0], [-1.5, 1.5, 0.0], [0.0, -1.5, 3.0]])
    found = G.encoder_errors(table(spark, x, np.zeros(300)), table(spark, odd, np.ones(4)), hidden=(8, 1), steps=60, rate=0.05, percentile=0.9).collect()
    assert all(r["error"] > r["threshold"] and r["label"] == -1 for r in found)


def test_fourier_features_come_near_the_kernel():
    x = np.random.default_rng(8).normal(size=(30, 4))
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    mapped = K.Fourier(4, 0.3, 4096)(x)
    assert np.abs(mapped @ mapped.T - exact).max() < 0.1


def test_kernel_machines(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    y = ((x ** 2).sum(1) > 1.4).astype(float)  # a ring, which no plane cuts off
    df = table(spark, x, y)
    inputs, gamma = K.width_of(df, "features")
    assert inputs == 2 and abs(gamma - 1 / (2 * x.var())) < 1e-9
    scored = K.KernelSVC(maxIter=30).fit(df).transform(df)
    assert scored.where("prediction = label").count() >= 0.95 * 400
    far = table(spark, [[6.0, 6.0], [-7.0, 5.0], [0.1, 0.0]], [0, 0, 0])
    got = {r["id"]: r["anomaly"] for r in K.one_class(df, far, nu=0.1, gamma=0.5, steps=40).collect()}
    assert got == {0: -1, 1: -1, 2: 1}
    inside = K.one_class(df, df, nu=0.1, gamma=0.5, steps=5).where("anomaly = -1").count()
    assert 36 <= inside <= 40


def test_steps_read_blocks_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3_000, 12)), rng.integers(0, 2, 3_000).astype(float)
    written = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    flat, losses = G.train(table(spark, x, y), NETS[1], label="label", steps=2, rate=0.05, seed=1)
    assert losses[0] == pytest.approx(NETS[1].loss(NETS[1].start(1), x, y)[0] / 3_000)
    sizes = [r["n"] for r in written[0].collect()]
    assert sum(sizes) == 3_000 and len(sizes) <= 2 * spark.sparkContext.defaultParallelism and max(sizes) <= G.BLOCK


def test_cosines_are_exact():
    z = np.r_[np.random.default_rng(1).normal(0, 30, 100_000), np.arange(-8, 9) * np.pi / 4]
    assert np.abs(K.cosines(z / (2 * np.pi)) - np.cos(z)).max() < 1e-13


def test_written_blocks_lie_in_small_parts(spark, monkeypatch):
    """A reader takes thousands of blocks at once, so no part may hold more than fits into memory."""
    from pyspark.sql import functions as F

    written, keep = [], G.materialize
    monkeypatch.setattr(G, "PART", 20_000, raising=False)
    monkeypatch.setattr(G, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3_000, 12)), rng.integers(0, 2, 3_000).astype(float)
    losses = G.train(table(spark, x, y), NETS[1], label="label", steps=2, rate=0.05, seed=1)[1]
    assert losses[0] == pytest.approx(NETS[1].loss(NETS[1].start(1), x, y)[0] / 3_000)
    held = [r["b"] for r in written[0].groupBy(F.input_file_name()).agg(F.sum(F.length("x") + F.length("y")).alias("b")).collect()]
    assert sum(held) == 3_000 * 13 * 8 and max(held) < 2 * 20_000


def test_errors_of_an_encoder_are_written_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df, names, keep = table(spark, rng.normal(size=(200, 3)), np.zeros(200)), [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: names.append((name, df.columns)) or keep(df, name))
    G.encoder_errors(df, df, hidden=(2,), steps=2)
    assert names[1:] == [("errors", ["error"])]


def test_quasi_newton_steps_reach_the_lowest_point():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(30, 12))
    a, b = m.T @ m + 0.01 * np.eye(12), rng.normal(size=12)
    passes = []

    def valley(x):
        passes.append(x)
        return 0.5 * float(x @ a @ x) - float(b @ x), a @ x - b

    assert np.allclose(G.minimised(valley, np.zeros(12), 200, 1e-12), np.linalg.solve(a, b), atol=1e-5) and len(passes) < 120
    curve = G.minimised(lambda x: ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array(
        [2 * (x[0] - 1) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])), np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.allclose(curve, 1.0, atol=1e-3)


def test_kernel_machine_writes_no_kernel_features(spark, monkeypatch):
    rng = np.random.default_rng(9)
    written, keep = [], G.materialize
    for m in (G, K):
        monkeypatch.setattr(m, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1], raising=False)
    x = rng.normal(size=(300, 2))
    fitted = K.KernelSVC(maxIter=30).fit(table(spark, x, ((x ** 2).sum(1) > 1.4).astype(float)))
    assert sum(r["b"] for w in written for r in w.select(K.F.length("x").alias("b")).collect()) == 300 * 2 * 8
    # the plane is near the lowest value of the penalised hinge loss: a random step raises it
    flat, net, y = fitted.flat, fitted.net, ((x ** 2).sum(1) > 1.4).astype(float)
    cost = lambda f: net.loss(f, x, y)[0] / 300 + 0.0005 * float(f[:-1] @ f[:-1])
    assert cost(flat) < 0.3 * cost(0 * flat) and all(cost(flat + rng.normal(0, 0.5, len(flat))) > cost(flat) for _ in range(20))


def test_dense_network_is_sparks_and_steps_over_blocks(spark, monkeypatch):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from tidewatch.operators import learn

    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] * x[:, 1] > 0) + (x[:, 2] > 1)).astype(float)
    net, df = G.Layers([3, 4, 5, 3]), table(spark, x, y)
    flat = rng.normal(0, 0.5, sum(int(np.prod(s)) for s in net.shapes))
    grad = net.loss(flat, x, y)[1]
    for k in range(len(flat)):
        move = np.zeros(len(flat))
        move[k] = 1e-6
        assert abs((net.loss(flat + move, x, y)[0] - net.loss(flat - move, x, y)[0]) / 2e-6 - grad[k]) < 1e-3
    written, keep = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    fitted = learn.dense_network(3, (8,), 3, 60).fit(df)
    own = MultilayerPerceptronClassifier(layers=[3, 8, 3], maxIter=60, seed=42).fit(df)
    cost = [G.Layers([3, 8, 3]).loss(m.weights.toArray(), x, y)[0] / 400 for m in (fitted, own)]
    assert len(written) == 1 and set(written[0].columns) == {"n", "x", "y"} and cost[0] < 1.2 * cost[1] + 0.02
    assert fitted.transform(df).where("prediction = label").count() > 0.9 * 400
