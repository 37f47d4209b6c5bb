"""Train resamples: draws, and all replicates at once against each fitted alone on copies of its rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import probe
from gradelake.operators.rank import auroc


def head_rows(spark, n=120, heads=3, d=3, seed=8, first=0):
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.4).astype(int)
    x = r.normal(size=(n, heads, d))
    x[:, 1, 0] += 1.2 * y
    x[:, 2, 1] -= 0.8 * y
    rows = [(first + i, int(y[i]), h, x[i, h].tolist()) for i in range(n) for h in range(heads)]
    shallow = [(first + i, [float(v) for v in r.normal(size=2) + y[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "idx long, y int, flat_head long, vec array<double>"), spark.createDataFrame(shallow, "idx long, shallow array<double>")


def test_draws_are_as_many_as_rows_and_hold_both_classes(spark):
    units = spark.createDataFrame([(i, int(i == 0)) for i in range(12)], "idx long, y int")
    got = {r.idx: r.w for r in probe.replicate_weights(units, 6, 3).collect()}
    w = np.array([got.get(i, [0] * 6) for i in range(12)])
    assert (w.sum(0) == 12).all() and (w[0] > 0).all() and (w[1:].sum(0) > 0).all()  # a third of single draws would lack row 0
    again = {r.idx: r.w for r in probe.replicate_weights(units.repartition(5), 6, 3).collect()}
    assert got == again
    one = probe.replicate_weights(units.filter("y = 0"), 2, 3).collect()
    assert len(one) == 11 and all(r.w == [0, 0] for r in one)
    assert probe.replicate_weights(units.limit(0), 2, 3).count() == 0


@pytest.mark.parametrize("detector", ["lr_raw", "lr_controlled"])
def test_replicates_at_once_are_each_alone(spark, detector):
    train, s1 = head_rows(spark)
    test, s2 = head_rows(spark, seed=9, first=1000)
    shallow = s1.unionByName(s2)
    got = {r.replicate: r.auroc for r in probe.train_resample_auc(train, test, 3, 4, 2, detector, shallow).collect()}
    weights = probe.replicate_weights(train.select("idx", "y").distinct(), 3, 4)
    assert set(got) == {0, 1, 2} and len(set(got.values())) == 3
    for r in (2,):
        copies = train.join(weights.select("idx", F.explode(F.sequence(F.lit(1).cast("long"), F.get("w", F.lit(r)))).alias("copy")).join(weights.filter(F.get("w", F.lit(r)) > 0).select("idx"), "idx", "left_semi"), "idx")
        copies = copies.filter("copy > 0")
        copies = spark.createDataFrame(copies.collect(), copies.schema)
        top = probe.head_ranking(probe.head_lda_auc(copies), 2, None)
        one = probe.features_of(copies, top, ("idx", "copy")).join(shallow, "idx")
        one = spark.createDataFrame(one.collect(), one.schema)
        scored = probe.score_with(detector, one, probe.features_of(test, top, ("idx",), shallow))
        assert auroc(scored.withColumn("run", F.lit("r")), ["run"]).first().auroc == pytest.approx(got[r], abs=1e-9)


def test_residuals_of_groups_are_those_of_each(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 3, [float(v) for v in r.normal(size=2)], [float(v) for v in r.normal(size=3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "idx long, g int, shallow array<double>, features array<double>")
    got = {x.idx: x.features for x in probe.residualize(df.filter("g < 2"), df, by="g").collect()}
    for g in (0, 1):
        own = df.filter(F.col("g") == g)
        for x in probe.residualize(own, own).collect():
            assert got[x.idx] == pytest.approx(x.features)
    assert all(got[x[0]] == x[3] for x in rows if x[1] == 2)
