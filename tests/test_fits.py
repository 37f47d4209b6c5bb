"""Sums as trees, Newton fits against a plain solver, stacks of fits, and record sets that are replaced whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import network, probe
from gradelake.operators.rank import auroc
from gradelake.plans import all_queries
from gradelake.sources import records


def rows(n=240, d=5, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * [1, 5, 0.1, 2, 1] + [0, 3, 0, -9, 1]
    x[:, 4] = 7.0  # a constant feature
    y = (x[:, 0] + 0.3 * x[:, 1] + r.normal(size=n) > 1.2).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(k), [float(v) for v in a]) for i, (a, k) in enumerate(zip(x, y, strict=True))], "idx long, y int, features array<double>")


def plain(x, y, c):
    """The same problem by gradient steps with a line search: scores of the rows."""
    sd = x.std(0)
    a = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(sd > 0, sd, 1)])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    loss = lambda b: 0.5 * (b[1:] ** 2).sum() + c * (w * np.logaddexp(0, np.where(y == 1, -(a @ b), a @ b))).sum()
    b, step = np.zeros(a.shape[1]), 1.0
    for _ in range(20_000):
        g = c * a.T @ (w * (1 / (1 + np.exp(-(a @ b))) - y)) + np.concatenate([[0], b[1:]])
        step *= 2
        while loss(b - step * g) > loss(b) - 0.5 * step * (g**2).sum() and step > 1e-12:
            step /= 2
        b = b - step * g
        if np.abs(g).max() < 1e-9:
            break
    return 1 / (1 + np.exp(-(a @ b)))


@pytest.mark.parametrize("c", [0.05, 0.5, 10.0])
def test_newton_agrees_with_another_solver(spark, c):
    x, y = rows()
    df = frame(spark, x, y)
    got = np.array([r.score for r in probe.fit_lr(df, df, c=c).orderBy("idx").collect()])
    assert np.abs(got - plain(x, y, c)).max() < 1e-6
    assert np.abs(got - np.array([r.score for r in probe.fit_lr(df.repartition(7), df, c=c).orderBy("idx").collect()])).max() < 1e-9


def test_wide_features_take_the_other_solver(spark, monkeypatch):
    x, y = rows()
    df = frame(spark, x, y)
    a = np.array([r.score for r in probe.fit_lr(df, df).orderBy("idx").collect()])
    monkeypatch.setattr(probe, "NEWTON_FEATURES", 2)
    b = np.array([r.score for r in probe.fit_lr(df, df).orderBy("idx").collect()])
    assert np.abs(a - b).max() < 1e-3


def test_a_stack_is_its_fits(spark):
    x, y = rows()
    df = frame(spark, x, y)
    fits = {"all": probe.Fit(), "c": probe.Fit(2.0), "two": probe.Fit(0.5, 2), "odd": probe.Fit(0.5, rows=F.col("idx") % 2 == 1), "one class": probe.Fit(rows=F.col("y") == 1), "none": probe.Fit(rows=F.col("idx") < 0)}
    models = probe.fit_stack(df, fits)
    score = {k: np.array([r.s for r in df.orderBy("idx").select(m.score("features").alias("s")).collect()]) for k, m in models.items()}
    assert np.abs(score["all"] - plain(x, y, 0.5)).max() < 1e-6 and np.abs(score["c"] - plain(x, y, 2.0)).max() < 1e-6
    assert np.abs(score["two"] - plain(x[:, :2], y, 0.5)).max() < 1e-6
    odd = np.arange(len(y)) % 2 == 1
    assert np.abs(score["odd"][odd] - plain(x[odd], y[odd], 0.5)).max() < 1e-6
    assert set(score["one class"]) == {1.0} and set(score["none"]) == {0.0}


def test_trees_of_very_many_tasks(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 3)).round(3)
    data = [(i % 2, int(i % 3 == 0), [float(v) for v in a]) for i, a in enumerate(x)]
    heads = spark.createDataFrame(data, "flat_head long, y int, vec array<double>")
    got = {(s.flat_head, s.y): s for s in probe.head_statistics(heads.repartition(500)).collect()}
    for h in (0, 1):
        for k in (0, 1):
            own = np.array([v for a, b, v in data if (a, b) == (h, k)])
            s = got[h, k]
            assert s.n == len(own) and np.allclose(s.s, own.sum(0)) and np.allclose(np.reshape(s.ss, (3, 3)), own.T @ own)
    plan = probe.head_statistics(heads)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert probe.head_statistics(heads.filter("y > 5")).count() == 0


def test_a_record_set_is_replaced_whole_or_not_at_all(spark, tmp_path):
    place = str(tmp_path / "set")
    old = spark.createDataFrame([(i, "old") for i in range(50)], "idx long, text string")
    records.replace_records(old, place)
    assert records.current_records(spark, place).filter("text = 'old'").count() == 50
    dies = spark.range(50, numPartitions=5).select(F.col("id").alias("idx"), F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise("new").cast("string").alias("text"))
    with pytest.raises(Exception, match="lost"):
        records.replace_records(dies, place)
    assert records.current_records(spark, place).filter("text = 'old'").count() == 50
    # rows made from the set itself may replace it
    records.replace_records(records.current_records(spark, place).withColumn("text", F.lit("new")), place)
    got = records.current_records(spark, place)
    assert got.filter("text = 'new'").count() == 50 and got.columns == ["idx", "text"]
    with pytest.raises(FileNotFoundError):
        records.current_records(spark, str(tmp_path / "nothing"))
    records.replace_records(old.limit(0), place)
    assert records.current_records(spark, place).count() == 0


def counted(df):
    """`df`, and the number of its rows that were read so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(read, df.schema), seen


def test_train_rows_are_read_once_for_both_variants(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(v[0] > 0), [float(k) for k in v], [float(v[1]), float(i % 7)]) for i, v in enumerate(r.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "idx long, y int, features array<double>, shallow array<double>")
    for model, how in (("lr", {}), ("mlp", {"seeds": (0, 1), "hidden": 4, "epochs": 2})):
        train, seen = counted(df)
        out = probe.fit_raw_and_controlled(train, df, model, **how)
        assert seen.value == 200
        assert out.count() == 400 and seen.value == 200  # nothing of train is read again with the result


def test_transfer_reads_each_split_once(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(v[0] + 0.3 * v[1] > 0), [float(k) for k in v]) for i, v in enumerate(r.normal(size=(300, 3)))], "idx long, y int, features array<double>")
    (train, fitted), (test, scored) = counted(df), counted(df)
    out = probe.transfer_matrix({"a": (train, test), "b": (df.filter("idx % 2 = 0"), df)})
    assert out.groupBy("source", "target").count().count() == 4
    assert (fitted.value, scored.value) == (300, 300)


def test_sweep_puts_train_rows_together_once(spark):
    r = np.random.default_rng(6)
    rows = [(i, h, int(i % 2), [float(k) for k in r.normal(size=2) + (i % 2) * h / 4]) for i in range(120) for h in range(4)]
    heads = spark.createDataFrame(rows, "idx long, flat_head long, y int, vec array<double>")
    shallow = spark.range(120).selectExpr("id AS idx", "array(CAST(id % 5 AS DOUBLE)) AS shallow")
    joined, seen = counted(shallow)
    out = probe.sweep(heads, heads, {"c": (0.05,), "hidden": (3,)}, {"topk": 2, "c": 0.5, "hidden": 2}, ("lr_controlled", "mlp_controlled", "mlp_raw"), joined, seeds=(0,), epochs=2)
    assert seen.value == 120
    assert {(x.axis, x.cell, x.detector) for x in out.collect()} == {("default", "default", d) for d in ("lr_controlled", "mlp_controlled", "mlp_raw")} | {("c", "0.05", "lr_controlled"), ("hidden", "3", "mlp_controlled"), ("hidden", "3", "mlp_raw")}


def test_the_sweep_query_has_the_whole_grid(spark, tmp_path):
    """Each number of heads, penalty and network by all four detectors, with the operator's own seeds and epochs."""
    r = np.random.default_rng(7)
    labels = r.integers(0, 10, 150)
    vectors = r.normal(size=(150, 64)) + (labels < 5)[:, None] * np.linspace(0, 0.6, 64)
    spark.createDataFrame([(i, int(k), [float(x) for x in v]) for i, (k, v) in enumerate(zip(labels, vectors, strict=True))], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, " ".join(["word", str(i * 7 % 13)] * (1 + i % 5))) for i in range(150)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = all_queries()[0]["sweep"](spark, str(tmp_path)).collect()
    topk, c, hidden = [("topk", str(k)) for k in (1, 2, 3, 5, 6, 7, 8)], [("c", x) for x in ("0.05", "0.1", "2.0", "10.0")], [("hidden", x) for x in ("32", "64", "256", "512", "(128, 128)")]
    cells = {"lr": [("default", "default"), *topk, *c], "mlp": [("default", "default"), *topk, *hidden]}
    assert sorted((x.axis, x.cell, x.detector) for x in rows) == sorted((*at, f"{model}_{kind}") for model, own in cells.items() for at in own for kind in ("raw", "controlled"))
    assert all(x.auroc > 0.6 for x in rows if x.cell == "8")


def test_networks_of_all_cells_are_one_stack(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, h, int(i % 2), [float(k) for k in r.normal(size=2) + (i % 2) * h / 4]) for i in range(120) for h in range(4)]
    heads = spark.createDataFrame(rows, "idx long, flat_head long, y int, vec array<double>")
    stacks, fit = [], network.fit_members
    monkeypatch.setattr(network, "fit_members", lambda df, members, *a, **how: (stacks.append((len(members), how["how"].epochs)), fit(df, members, *a, **how | {"how": network.Training(epochs=2)}))[1])
    out = probe.sweep(heads, heads, {"topk": (1, 99), "hidden": (3, (4, 4))}, {"topk": 4, "c": 0.5, "hidden": 2}, ("lr_raw", "mlp_raw"))
    assert stacks == [(5 * 5, 300)]
    got = {(x.detector, x.cell): x.auroc for x in out.collect()}
    assert len(got) == 8 and got["lr_raw", "99"] == got["lr_raw", "default"] and got["mlp_raw", "99"] == got["mlp_raw", "default"]


def test_networks_of_a_sweep_are_those_fitted_alone(spark):
    """Rows are dealt to batches by raw features: those controlled come from sums, whose last digits differ from run to run."""
    r = np.random.default_rng(9)
    rows = [(i, h, int(i % 2), [float(k) for k in r.normal(size=2) + (i % 2) * h / 4]) for i in range(120) for h in range(4)]
    heads = spark.createDataFrame(rows, "idx long, flat_head long, y int, vec array<double>")
    shallow = spark.range(120).selectExpr("id AS idx", "array(CAST(id % 5 AS DOUBLE)) AS shallow")
    how = {"seeds": (0, 1), "epochs": 3}
    out = probe.sweep(heads, heads, {"topk": (1,)}, {"topk": 4, "c": 0.5, "hidden": 3}, ("mlp_controlled", "mlp_raw"), (shallow, shallow), **how).collect()
    got = {(x.detector, x.cell): x.auroc for x in out}
    train = probe.features_of(heads, probe.head_ranking(probe.head_lda_auc(heads), 4, None), ("idx",))
    alone = auroc(probe.score_with("mlp_raw", train, train, hidden=3, **how), []).first().auroc
    assert len(got) == 4 and got["mlp_raw", "default"] == pytest.approx(alone, abs=1e-9)
