"""Networks against the same training in NumPy alone, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import network, probe


def rings(n, seed):
    """Rows that no line tells apart: y goes by the distance from the middle."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 6)) * [1, 30, 1, 1, 0.01, 1] + [0, 5, 0, 0, 1, 0]
    d = x[:, 0] ** 2 + ((x[:, 1] - 5) / 30) ** 2
    return x, (d + 0.3 * r.normal(size=n) > 1.0).astype(int)


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(k), [float(v) for v in a]) for i, (a, k) in enumerate(zip(x, y, strict=True))], "idx long, y int, features array<double>")


def auc(score, y):
    a, b = score[y == 1][:, None], score[y == 0][None]
    return np.mean(a > b) + np.mean(a == b) / 2


def plain(x, y, x_test, hidden, seed, batch=200, epochs=300):
    """Adam on shuffled minibatches, stopped on held-out rows, in NumPy with its own loop."""
    r = np.random.default_rng(seed)
    mu, sd = x.mean(0), x.std(0)
    a, t = (x - mu) / sd, (x_test - mu) / sd
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    order = r.permutation(len(y))
    held, own = order[: int(0.15 * len(y))], order[int(0.15 * len(y)) :]
    lim, lim2 = np.sqrt(6 / (x.shape[1] + hidden)), np.sqrt(6 / (hidden + 1))
    p = [r.uniform(-lim, lim, (x.shape[1], hidden)), r.uniform(-lim, lim, hidden), r.uniform(-lim2, lim2, hidden), r.uniform(-lim2, lim2, 1)]
    m, v, step, best, top, waited = [0 * q for q in p], [0 * q for q in p], 0, p, -1.0, 0
    out = lambda q, z: np.maximum(z @ q[0] + q[1], 0) @ q[2] + q[3]
    for _ in range(epochs):
        r.shuffle(own)
        for at in range(0, len(own), batch):
            k = own[at : at + batch]
            z = np.maximum(a[k] @ p[0] + p[1], 0)
            e = w[k] * (1 / (1 + np.exp(-(z @ p[2] + p[3]))) - y[k]) / w[k].sum()
            back = e[:, None] * p[2] * (z > 0)
            g = [a[k].T @ back + 1e-4 * p[0] / len(k), back.sum(0), z.T @ e + 1e-4 * p[2] / len(k), e.sum(keepdims=True)]
            step += 1
            m = [0.9 * i + 0.1 * j for i, j in zip(m, g, strict=True)]
            v = [0.999 * i + 0.001 * j * j for i, j in zip(v, g, strict=True)]
            rate = 1e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            p = [i - rate * j / (np.sqrt(k2) + 1e-8) for i, j, k2 in zip(p, m, v, strict=True)]
        hit = np.average((out(p, a[held]) > 0) == (y[held] == 1), weights=w[held])
        waited = 0 if hit > top + 1e-4 else waited + 1
        best, top = (p, hit) if hit > top else (best, top)
        if waited >= 10:
            break
    return 1 / (1 + np.exp(-out(best, t)))


def test_it_ranks_like_the_same_training_in_numpy(spark):
    x, y = rings(2400, 1)
    x_test, y_test = rings(1500, 2)
    seeds = (0, 1, 2)
    got = probe.ensemble(probe.fit_mlp_ensemble(frame(spark, x, y), frame(spark, x_test, y_test), seeds, 64)).orderBy("idx").collect()
    want = np.mean([plain(x, y, x_test, 64, s) for s in seeds], 0)
    found, wanted = auc(np.array([r.score for r in got]), y_test), auc(want, y_test)
    assert wanted > 0.9 and found == pytest.approx(wanted, abs=0.01)
    line = np.array([r.score for r in probe.fit_lr(frame(spark, x, y), frame(spark, x_test, y_test)).orderBy("idx").collect()])
    assert auc(line, y_test) < 0.7


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(4)
    x, y, w = r.normal(size=(30, 3)), r.integers(0, 2, 30), r.uniform(0.5, 2, 30)
    net = network.started(3, 5, 9)
    g = net.gradient(x, y, w)
    for i in range(len(net.at)):
        d = np.zeros(len(net.at))
        d[i] = 1e-6
        up, down = (network.Network(3, 5, net.at + k * d).gradient(x, y, w)[-2] for k in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)
    mean, sd = np.array([1.0, -2.0, 0.5]), np.array([2.0, 0.1, 1.0])
    assert np.allclose(net.on_raw(mean, sd).logit(x * sd + mean)[1], net.logit(x)[1])


def test_a_fit_does_not_depend_on_partitions_or_tasks(spark, monkeypatch):
    x, y = rings(500, 5)
    df = frame(spark, x, y)
    get = lambda d: np.array([r.score for r in probe.fit_mlp_ensemble(d, df, (3,), 8, epochs=6).orderBy("idx").collect()])
    one = get(df)
    assert np.abs(one - get(df.repartition(7).orderBy(F.desc("idx")))).max() < 1e-9
    monkeypatch.setattr(network, "ROWS_A_PART", 60)  # eight parts
    assert np.abs(one - get(df)).max() < 1e-9
    monkeypatch.setattr(network, "FAN", 2)  # their sums as a tree
    assert np.abs(one - get(df)).max() < 1e-9


def test_edges(spark):
    x, y = rings(60, 6)
    df = frame(spark, x, y)
    gaps = df.withColumn("features", F.when(F.col("idx") % 9 > 0, F.col("features"))).withColumn("y", F.when(F.col("idx") % 7 > 0, F.col("y"))).withColumn("member", F.lit("old"))
    got = probe.fit_mlp_ensemble(gaps, gaps, (0, 1), 4, epochs=2)
    rows = got.collect()
    assert len(rows) == 120 and {r.member for r in rows} == {0, 1}
    assert all((r.score is None) == (r.idx % 9 == 0) for r in rows) and all(r.score is None or 0 <= r.score <= 1 for r in rows)
    assert {r.score for r in probe.fit_mlp_ensemble(df.filter("y = 1"), df, (0, 1), 4).collect()} == {1.0}
    assert {r.score for r in probe.fit_mlp_ensemble(df.limit(0), df, (0,), 4).collect()} == {0.0}
    assert probe.fit_mlp_ensemble(df, df.limit(0), (0,), 4, epochs=1).count() == 0
    # one row of a class: nothing is held out, training stops by its loss
    few = df.filter("y = 0").unionByName(df.filter("y = 1").limit(1))
    assert probe.fit_mlp_ensemble(few, df, (0,), 4, epochs=3).filter("score is null").count() == 0


def test_what_comes_to_the_driver_follows_no_number_of_tasks(spark, monkeypatch):
    """A step brings one gradient a member, whether the rows lie in 3 parts or in 24."""
    x, y = rings(1200, 3)
    df = frame(spark, x, y).persist()
    df.count()

    def results():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
        it, total = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, *none).iterator(), 0
        while it.hasNext():
            total += it.next().resultSize()
        return total

    def sent(rows_a_part):
        monkeypatch.setattr(network, "ROWS_A_PART", rows_a_part)
        before = results()
        nets = network.fit_ensemble(df, (0, 1), 512, how=network.Training(epochs=1))
        return results() - before, nets

    (few, a), (many, b) = sent(400), sent(50)
    df.unpersist()
    assert many < 2 * few
    assert all(np.allclose(i.at, j.at, atol=1e-9) for i, j in zip(a, b, strict=True))


def test_a_stack_of_networks_is_its_fits(spark, monkeypatch):
    """Cells of other units, layers and columns in one stack, side by side in tasks and step by step over tasks."""
    x, y = rings(500, 7)
    df, how = frame(spark, x, y), network.Training(epochs=4)
    members = [network.Member(0, 8), network.Member(3, 8), network.Member(0, (5, 4)), network.Member(3, 6, 1, 2), network.Member(0, 300)]
    nets = network.fit_members(df, members, how=how)
    for i in (0, 1, 2, 4):
        assert np.abs(nets[i].at - network.fit_ensemble(df, (members[i].seed,), members[i].hidden, how=how)[0].at).max() < 1e-9
    assert (nets[3].width, len(nets[3].at)) == (2, 2 * 6 + 6 + 6 + 1)
    other = x.copy()
    other[:, [0, 3, 4, 5]] = 9.0
    assert np.array_equal(nets[3].logit(x)[1], nets[3].logit(other)[1])
    monkeypatch.setattr(network, "ROWS_A_PART", 60)
    assert all(np.abs(a.at - b.at).max() < 1e-9 for a, b in zip(nets, network.fit_members(df, members, how=how), strict=True))
    monkeypatch.setattr(network, "NUMBERS_A_STEP", 100)  # some members after others
    assert all(np.abs(a.at - b.at).max() < 1e-9 for a, b in zip(nets, network.fit_members(df, members, how=how), strict=True))
    got = df.select("idx", network.scores(df, nets[:4], [1, 1, 2]).alias("p")).orderBy("idx").collect()
    assert np.allclose(got[5].p[2], np.mean([1 / (1 + np.exp(-n.logit(x)[1][5])) for n in nets[2:4]]))


def test_gradients_of_two_hidden_layers():
    r = np.random.default_rng(8)
    x, y, w = r.normal(size=(30, 5)), r.integers(0, 2, 30), r.uniform(0.5, 2, 30)
    net = network.started(3, (5, 4), 9, 1)
    g = net.gradient(x, y, w)
    for i in range(len(net.at)):
        d = np.zeros(len(net.at))
        d[i] = 1e-6
        up, down = (network.Network(3, (5, 4), net.at + k * d, 1).gradient(x, y, w)[-2] for k in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)
    mean, sd = r.normal(size=5), r.uniform(0.5, 2, 5)
    assert np.allclose(net.on_raw(mean, sd).logit(x * sd + mean)[1], net.logit(x)[1])
