"""Models learned in rounds against definitions, loops and other partitionings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosift.operators import base, learning
from chronosift.operators import detectors as D
from chronosift.operators import sequence as Q


def series(spark, n=300, gap=1):
    rng = np.random.default_rng(4)
    rows = [(gap * i, float(np.sin(i / 5)), float(i % 7), None if i % 50 == 3 else float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "window_id long, a double, b double, c double").repartition(5)


def values(df, names):
    x = df.toPandas().sort_values("window_id")[names].fillna(0.0).to_numpy(float)
    return x


def slopes(error, theta):
    return np.array([(error(theta + 1e-6 * e) - error(theta - 1e-6 * e)) / 2e-6 for e in np.eye(len(theta))])


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    net = Q.Lstm(3, 4, 5)
    s = rng.normal(size=(7, 6, 3))
    theta = net.start(1)
    assert np.allclose(net.gradient(theta, s), slopes(lambda t: net.error(t, s) / len(s), theta), atol=1e-7)
    dense = D._Dense([3, 4, 2, 4, 3])
    x, theta = rng.normal(size=(9, 3)), rng.normal(size=dense.size)
    assert np.allclose(dense.gradient(theta, x), slopes(lambda t: dense.error(t, x) / len(x), theta), atol=1e-6)


def test_lstm_is_causal_and_follows_the_gates():
    net = Q.Lstm(2, 3, 4)
    theta, x = net.start(2), np.random.default_rng(1).normal(size=(1, 4, 2))
    out = net.forward(theta, x)[0]
    later = x.copy()
    later[:, 2:] += 5
    assert np.array_equal(net.forward(theta, later)[0][:, :2], out[:, :2]) and not np.allclose(net.forward(theta, later)[0], out)
    w, u, b, v, c0 = net._parts(theta)
    sig = lambda z: 1 / (1 + np.exp(-z))
    h = c = np.zeros(3)
    for t in range(4):
        i, f, g, o = np.split(x[0, t] @ w + h @ u + b, 4)
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
        assert np.allclose(out[0, t], h @ v + c0)


def test_places(spark):
    d = series(spark, 100, 13).unionByName(series(spark, 2, 13))  # the first two rows stand twice
    got = sorted((r.window_id, r[learning.PLACE]) for r in learning.placed(d, "window_id", ["a", "b"]).collect())
    assert [p for _, p in got] == list(range(102)) and [w for w, _ in got[:4]] == [0, 0, 13, 13]


def test_shards_hold_all_rows(spark):
    d = series(spark, 100)
    shards, mean, std = learning.training_shards(d, "window_id", ["a", "b"], 0.8, 5, 16)
    x = (values(d, ["a", "b"]) - mean) / std
    assert np.allclose(mean, values(d, ["a", "b"])[:80].mean(0)) and np.allclose(std, values(d, ["a", "b"])[:80].std(0))
    for r in shards.collect():
        lo, hi = (0, 80) if r.part == 0 else (80, 100)
        # a shard of the later rows may begin before them
        want = x[max(lo, 16 * r.shard) : min(hi, 16 * r.shard + 21)]
        assert np.allclose(np.frombuffer(r.x).reshape(-1, 2), want)
    assert sorted({r.shard for r in shards.collect() if r.part == 0}) == list(range(5))


@pytest.mark.parametrize("kind", ["sequence", "autoencoder"])
def test_learning_ignores_the_partitioning(spark, kind):
    d = series(spark)
    make = (lambda: D.SequenceModel(["a", "b"], 4, 6, rounds=3)) if kind == "sequence" else (lambda: D.Autoencoder(["a", "b", "c"], 6, 2, rounds=3))
    one, two = make().fit(d, "window_id"), make().fit(d.repartition(9), "window_id")
    assert np.allclose(one.theta, two.theta, atol=1e-9)
    errors = np.array(one.history)
    assert errors.shape == (4, 2) and errors[-1, 0] < errors[0, 0]


def test_rounds_end_when_later_rows_get_worse(spark):
    rows = [(i, float(i % 5), float(i % 3)) if i < 160 else (i, 40.0 * (i % 2), -30.0) for i in range(200)]
    d = spark.createDataFrame(rows, "window_id long, a double, b double")
    m = D.Autoencoder(["a", "b"], 8, 2, rounds=40, rate=0.05, batch=16, patience=2).fit(d, "window_id")
    later = [e[1] for e in m.history]
    best = int(np.argmin(later))
    assert len(later) < 41 and best == len(later) - 4
    x = (values(d, ["a", "b"])[160:] - m.mean) / m.std
    assert np.isclose(D._Dense(m.sizes).errors(m.theta, x).mean(), later[best], atol=1e-4)


@pytest.mark.parametrize("gap", [1, 20_000])
def test_sequence_scores_equal_a_loop(spark, gap):
    d = series(spark, 120, gap)
    m = D.SequenceModel(["a", "b", "c"], 6, 5, rounds=2).fit(d)
    x = (values(d, ["a", "b", "c"]) - m.mean) / m.std
    net = m._net()
    want = [0.0] + [float(((net.forward(m.theta, x[None, max(0, t - 6) : t])[0][0, -1] - x[t]) ** 2).mean()) for t in range(1, len(x))]
    got = [r.raw_score for r in m.score(d).orderBy("window_id").collect()]
    assert got[0] == 0.0 and np.allclose(got, want)


@pytest.mark.parametrize("n,shard", [(100, 16), (100, 4096), (7, 4), (6, 4), (1, 4)])
def test_overlapping_scores_equal_a_loop(spark, n, shard):
    d = series(spark, n)
    net, length = Q.Lstm(2, 3, 6), 6
    theta, x = net.start(3), values(d, ["a", "b"])
    total, count = np.zeros(n), np.zeros(n)
    for i in range(n - length):
        out = net.forward(theta, x[None, i : i + length])[0][0]
        for j in range(length):
            total[i + j + 1] += ((out[j] - x[i + j + 1]) ** 2).mean()
            count[i + j + 1] += 1
    want = np.divide(total, count, out=np.zeros(n), where=count > 0)
    rows = Q.overlapping_scores(d, "window_id", ["a", "b"], length, lambda s: net.errors(theta, s), shard=shard)
    assert rows.columns == ["window_id", "a", "b", "c", "raw_score"]
    assert np.allclose([r.raw_score for r in rows.orderBy("window_id").collect()], want)


def test_sequence_detector_survives_saving(spark, tmp_path):
    d = series(spark, 80)
    m = base.SequenceDetector(["a", "b"])
    m.model.rounds = 2
    m.fit(d)
    m.save(spark, f"file://{tmp_path}/m")
    again = base.Detector.load(spark, f"file://{tmp_path}/m")
    a, b = ([r.raw_score for r in x.score(d).orderBy("window_id").collect()] for x in (m, again))
    assert a == b and a[0] == 0.0 and max(a) > 0


def test_tree_samples_are_the_smallest_keys_of_all_rows(spark):
    d = series(spark, 900)
    rows = d.select(F.xxhash64("window_id").alias("h"), F.coalesce("a", F.lit(0.0)), F.coalesce("c", F.lit(0.0))).collect()
    keys = D.tree_keys(np.array([r[0] for r in rows], np.int64).view(np.uint64), 5, 42)
    for parts in (1, 6):
        got = D.tree_samples(d.repartition(parts), "window_id", ["a", "c"], 5, 64, 42)
        for t in range(5):
            want = [tuple(rows[i][1:]) for i in np.argsort(keys[:, t])[:64]]
            assert [tuple(x) for x in got[t].tolist()] == want
    assert len({tuple(map(tuple, got[t].tolist())) for t in range(5)}) == 5
    few = D.tree_samples(d.where("window_id < 10"), "window_id", ["a"], 3, 64, 42)
    assert [len(few[t]) for t in range(3)] == [10] * 3


def test_pca_of_two_features(spark):
    d = series(spark, 200)
    m = D.Pca(["a", "b"], 0.5).fit(d)
    x = values(d, ["a", "b"])
    z = (x - x.mean(0)) / x.std(0)
    sign = np.sign(np.corrcoef(z.T)[0, 1])
    got = [r.raw_score for r in m.score(d).orderBy("window_id").collect()]
    assert np.allclose(got, (z[:, 0] - sign * z[:, 1]) ** 2 / 4)
