"""Rank metrics, routing and resampling against plain numpy and their invariants."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import checks, rank, resample, routing


def scores(n, levels, seed):
    g = np.random.default_rng(seed)
    y = (g.random(n) < 0.7).astype(int)
    s = np.round((g.random(n) + 0.4 * y) * levels) / levels
    return s, y


def frame(spark, groups):
    rows = [(k, int(i), float(a), int(b)) for k, (s, y) in groups.items() for i, (a, b) in enumerate(zip(s, y, strict=True))]
    return spark.createDataFrame(rows, "run string, idx long, score double, y int")


GROUPS = {"fine": scores(400, 10**6, 1), "ties": scores(500, 5, 2), "tied": (np.ones(50), scores(50, 2, 3)[1]), "right": (np.arange(20.0), np.ones(20, int)), "one": (np.array([0.5]), np.array([0])), "perfect": (np.array([1.0, 2, 8, 9]), np.array([0, 0, 1, 1]))}


def brute(s, y):
    pairs = [(a > b) + (a == b) / 2 for a, b in itertools.product(s[y == 1], s[y == 0])]
    order = np.argsort(-s, kind="stable")
    # expectation over orders within ties: every tied row carries its group's mean
    wrong = np.array([(1 - y)[s == v].mean() for v in s])[order]
    risk = np.cumsum(wrong) / np.arange(1, len(s) + 1)
    ap = np.mean([(1 - y)[s <= v].sum() / (s <= v).sum() for v in s[y == 0]]) if (y == 0).any() else None
    return (np.mean(pairs) if pairs else None), ap, risk


@pytest.mark.parametrize("part_cells", [None, 1, 7])
def test_rank_metrics(spark, part_cells):
    got = {r.run: r for r in rank.rank_metrics(frame(spark, GROUPS), ["run"], part_cells=part_cells).collect()}
    for k, (s, y) in GROUPS.items():
        au, ap, risk = brute(s, y)
        assert got[k].auroc == (None if au is None else pytest.approx(au)) and got[k].ap == (None if ap is None else pytest.approx(ap))
        assert got[k].aurc == pytest.approx(risk.mean()) and got[k].n == len(s)
    assert got["perfect"].auroc == 1 and got["tied"].auroc == 0.5 and got["right"].auroc is None
    assert rank.rank_metrics(frame(spark, GROUPS).limit(0), ["run"]).count() == 0


def test_budgets_and_coverage(spark):
    df = frame(spark, GROUPS)
    for r in rank.budget_metrics(df, ["run"], budgets=(0.02, 0.1, 0.5), part_cells=3).collect():
        s, y = GROUPS[r.run]
        n, wrong = len(s), (1 - y).sum()
        m = max(1, min(n - 1, int(np.floor(r.budget * n + 0.5))))
        mean = sorted((v, (1 - y)[s == v].mean()) for v in s)
        caught = sum(w for _, w in mean[:m])
        assert r.reviewed == m and r.recall == (pytest.approx(caught / wrong) if wrong else None)
        assert r.residual_risk == (pytest.approx((wrong - caught) / (n - m)) if n > m else None)
    for r in rank.selective_error(df, ["run"]).collect():
        risk = brute(*GROUPS[r.run])[2]
        assert r.risk == pytest.approx(risk[max(1, int(r.coverage * len(risk))) - 1])
    last = rank.risk_coverage(df, ["run"]).filter("coverage = 1").collect()
    assert all(r.risk == pytest.approx(1 - GROUPS[r.run][1].mean()) for r in last) and len(last) == len(GROUPS)


def test_harmonic_numbers(spark):
    for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 127, 128, 129, 5000)], "n long").select("n", rank.harmonic(F.col("n")).alias("h")).collect():
        assert r.h == pytest.approx(sum(1 / i for i in range(1, r.n + 1)), rel=1e-14)


def test_wilson_brackets_the_share(spark):
    rows = [(k, n) for n in (0, 1, 2, 7, 100) for k in range(n + 1)]
    low, high = rank.wilson_interval(F.col("k"), F.col("n"))
    for r in spark.createDataFrame(rows, "k long, n long").select("k", "n", low.alias("a"), high.alias("b")).collect():
        assert (r.a, r.b) == (None, None) if r.n == 0 else 0 <= r.a <= r.k / r.n <= r.b <= 1


def test_an_unknown_share_has_no_interval(spark):
    low, high = rank.wilson_interval(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(None, 4), (2, None), (None, None), (0, 4)], "k long, n long").select(low.alias("a"), high.alias("b")).collect()
    assert [tuple(r) for r in rows[:3]] == [(None, None)] * 3 and rows[3].a == 0 and 0 < rows[3].b < 1


def test_unreachable_precision_is_null(spark):
    df = frame(spark, GROUPS).withColumn("error_score", 1 - F.col("score"))
    goal = df.select("run").distinct().withColumn("target", F.lit(1.1))
    thr = rank.threshold_at_precision(df, goal, ["run"])
    assert thr.filter("threshold is not null").count() == 0
    assert rank.operating_point(df, thr, ["run"]).filter("recall is not null or n_flagged is not null").count() == 0


def routing_rows(spark, n=120, seed=3):
    g = np.random.default_rng(seed)
    rows = [("r", i, int(a), int(b), float(s)) for i, (a, b, s) in enumerate(zip(g.random(n) < 0.6, g.random(n) < 0.7, np.round(g.random(n), 1), strict=True))]
    return spark.createDataFrame(rows, "run string, idx long, greedy_ok int, major_ok int, score double"), rows


def test_routing_identities(spark):
    df, rows = routing_rows(spark)
    acc = {r.fraction: r.accuracy for r in routing.routed_accuracy(df, ["run"]).collect()}
    assert acc[0.0] == pytest.approx(np.mean([r[2] for r in rows])) and acc[1.0] == pytest.approx(np.mean([r[3] for r in rows]))
    gain = {r.fraction: r.gain_over_random for r in routing.gain_over_random(df, ["run"]).collect()}
    assert gain[0.0] == pytest.approx(0) and gain[1.0] == pytest.approx(0)
    assert checks.check_routing_identity(df, ["run"]).first().max_discrepancy < 1e-12
    # expectation by simulation of the tied order
    g = np.random.default_rng(1)
    sims = []
    for _ in range(600):
        order = sorted(rows, key=lambda r: (r[4], g.random()))
        sims.append(np.mean([r[3] if k < 36 else r[2] for k, r in enumerate(order)]))
    assert abs(np.mean(sims) - acc[0.3]) < 0.01


def test_identities(spark):
    df = frame(spark, {k: v for k, v in GROUPS.items() if k not in ("right", "one")})
    assert all(r.discrepancy < 1e-12 for r in checks.check_auroc_identity(df, ["run"]).collect())
    long = df.withColumn("detector", F.lit("probe")).unionByName(df.withColumn("score", F.round("score", 1)).withColumn("detector", F.lit("judge")))
    r = checks.check_risk_identity(checks.fixed_budget_table(long), checks.main_metrics(long)).collect()
    assert all(x.max_discrepancy < 1e-12 for x in r)


def test_bootstrap_draws(spark):
    s, y = scores(200, 50, 5)
    df = frame(spark, {"a": (s, y)}).withColumn("template", F.col("idx") % 20)
    w = resample.bootstrap_weights(df, 30, 1, strata="y")
    per = w.groupBy("b", "y").agg(F.sum("w").alias("n")).collect()
    assert all(r.n == (y == r.y).sum() for r in per) and len(per) == 60
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, resample.bootstrap_weights(df.repartition(5), 30, 1, strata="y").collect()))
    both = df.withColumns({"score_a": F.col("score"), "score_b": F.col("score")})
    assert all(r.auroc == 0 and r.ap == 0 for r in resample.paired_bootstrap(both, "score_a", "score_b", 5, 1).collect())
    assert all(r.difference == 0 for r in resample.cluster_bootstrap(both, "score_a", "score_b", "template", 5, 1).collect())


def test_cell_metrics_are_those_of_rows(spark):
    s, y = GROUPS["ties"]
    got = resample.cell_metrics(s, (1 - y).astype(float), y.astype(float), (0.1,))
    r = rank.rank_metrics(frame(spark, {"ties": (s, y)}), ["run"]).first()
    b = rank.budget_metrics(frame(spark, {"ties": (s, y)}), ["run"], budgets=(0.1,)).first()
    assert got == pytest.approx([r.auroc, r.ap, r.aurc, b.recall, b.residual_risk])


def test_both_bootstraps_agree(spark):
    g = np.random.default_rng(2)
    y = (g.random(250) < 0.6).astype(int)
    rows = [("r", i, float(np.round(g.random() + 0.5 * v, 1)), float(np.round(g.random() + 0.2 * v, 1)), int(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "run string, idx long, score_a double, score_b double, y int")
    a = resample.percentile_ci(resample.paired_bootstrap(df, "score_a", "score_b", 150, 3), "auroc", ("run",)).first()
    b = resample.percentile_ci(resample.paired_intervals(df, "score_a", "score_b", 400, 3), "auroc", ("run",)).first()
    assert abs(a["mean"] - b["mean"]) < 0.02 and abs(a.low - b.low) < 0.05 and abs(a.high - b.high) < 0.05 and a.excludes_zero == b.excludes_zero


def test_two_sample_delta_of_one_score_with_itself_is_zero(spark):
    df = frame(spark, {"r": scores(120, 30, 4)}).withColumn("template", F.col("idx") % 12)
    d = resample.two_sample_delta(df, df, "score", 4, 1, minus="score").collect()
    assert all(r.difference == 0 for r in d)


def test_groups_of_null_are_groups(spark):
    df = spark.createDataFrame([(None, 0.1, 0), (None, 0.9, 1), ("a", 0.5, 1), ("a", 0.7, 0)], "run string, score double, y int")
    assert {r.run: r.auroc for r in rank.auroc(df, ["run"]).collect()} == {None: 1.0, "a": 0.0}
    assert {r.run: r.reviewed for r in rank.budget_metrics(df, ["run"], budgets=(0.5,)).collect()} == {None: 1, "a": 1}


@pytest.mark.parametrize("part_cells", [1 << 16, 10])
def test_intervals_are_the_same_beyond_the_cells_that_are_sent(spark, monkeypatch, part_cells):
    monkeypatch.setattr(resample, "PART_CELLS", part_cells)
    g = np.random.default_rng(4)
    y = (g.random(150) < 0.6).astype(int)
    rows = [("r", i, float(np.round(a, 1)), float(b), int(c)) for i, (a, b, c) in enumerate(zip(g.random(150) + y, g.random(150), y, strict=True))]
    rows += [("s", i, float(i % 3), float(i % 4), int(i % 5 > 1)) for i in range(90)] + [(None, i, float(i), 0.5, i % 2) for i in range(9)]
    df = spark.createDataFrame(rows, "run string, idx long, a double, b double, y int")
    few = resample.paired_intervals(df, "a", "b", 12, 3, budgets=(0.1,))
    want = {(r.run, r.b): r for r in few.collect()}
    monkeypatch.setattr(resample, "MAX_CELLS", 20)
    many = resample.paired_intervals(df.repartition(5), "a", "b", 12, 3, budgets=(0.1,))
    assert few.columns == many.columns and [f.dataType for f in few.schema] == [f.dataType for f in many.schema]
    got = {(r.run, r.b): r for r in many.collect()}
    assert got.keys() == want.keys() and len(got) == 36
    for k, r in got.items():
        assert tuple(r)[2:] == pytest.approx(tuple(want[k])[2:], abs=1e-12, nan_ok=True)


def test_draws_split_down_to_parts_are_multinomial():
    n = np.array([5, 1, 30, 2, 12, 7, 3])
    sizes = [slice(0, 2), slice(2, 3), slice(3, 6), slice(6, 7)]
    cuts = np.append(0, np.cumsum([n[s].sum() for s in sizes]))
    draws = np.array([np.concatenate([resample.part_draws(n[s], cuts, i, (1, b, 0), b"r") for i, s in enumerate(sizes)]) for b in range(4000)])
    assert (draws.sum(1) == 60).all()
    p = n / 60
    want = 60 * (np.diag(p) - np.outer(p, p))
    assert np.abs(draws.mean(0) - n).max() < 5 * np.sqrt(want.max() / 4000)
    assert np.abs(np.cov(draws.T) - want).max() < 0.08 * want.max()


def test_numbers_of_units_are_a_permutation(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 500), ("b", 3), (None, 7)) for i in range(n)], "run string, idx long")
    got = resample.numbered(df, ["run"], "idx").collect()
    for k, n in (("a", 500), ("b", 3), (None, 7)):
        own = [r for r in got if r.run == k]
        assert sorted(r._i for r in own) == list(range(n)) and {r._n for r in own} == {n}


def test_error_detection_report(spark):
    rows = [("t", i, i / 100, int(i < 70), int(i < 60)) for i in range(100)]
    train = spark.createDataFrame(rows, "run string, idx long, error_score double, y int, verdict_yes int")
    test = train.withColumn("error_score", 1 - F.col("error_score"))
    r = rank.error_detection(train, test, ["run"]).first()
    assert (r.n, r.n_wrong, r.target, r.threshold) == (100, 30, 0.75, 0.6) and r.n_flagged == 41
    assert r.recall == 0.0 and r.judge_recall == 1.0 and r.recall_difference == -1.0 and r.oracle_recall is None and r.recall_low == 0.0
    none = rank.error_detection(train.withColumn("verdict_yes", F.lit(1)), test, ["run"]).first()
    assert none.threshold is None and none.recall is None and none.recall_low is None and none.judge_recall == 1.0


def test_running_sums_in_parts(spark):
    """Groups of one part and of many, null groups, ties and both directions against a plain loop; the cells are never moved by their group alone."""
    r = random.Random(8)
    cells = [(g, float(i), r.randrange(1, 5), r.randrange(3)) for g, n in (("a", 700), ("b", 3), (None, 90)) for i in r.sample(range(2000), n)]
    df = spark.createDataFrame(cells, "run string, score double, n long, pos long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for down in (False, True):
            out = rank.with_running(df, ["run"], down, ("n", "pos"), part_cells=10)
            want = {}
            for g in ("a", "b", None):
                seen = [0, 0]
                own = sorted((c for c in cells if c[0] == g), key=lambda c: c[1], reverse=down)
                for c in own:
                    want[g, c[1]] = (*seen, sum(x[2] for x in own), sum(x[3] for x in own))
                    seen = [seen[0] + c[2], seen[1] + c[3]]
            assert {(x.run, x.score): (x.n_before, x.pos_before, x.n_all, x.pos_all) for x in out.collect()} == want
        import io
        from contextlib import redirect_stdout

        with redirect_stdout(io.StringIO()) as said:
            rank.with_running(rank.tie_groups(df.withColumn("y", F.col("pos")), ["run"]), ["run"]).explain("simple")
        plan = said.getvalue()
        assert "SortMergeJoin" not in plan
        # every exchange by run alone stands above a partial aggregate, or above totals of parts
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning(run#" in line and re.search(r"hashpartitioning\(run#\d+, \d+\)", line):
                assert re.search("partial_|HashAggregate|Project", lines[i + 1]) and "Scan" not in lines[i + 1], line
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_follow_the_number_of_cells(spark):
    big = spark.range(30_000).select(F.lit("a").alias("run"), F.col("id").cast("double").alias("score"), F.lit(1).cast("long").alias("n"))
    cuts = spark.range(1).select(F.array(*[F.lit(float(x)) for x in range(200)]).alias("c"), F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.5), F.lit(63.5), F.lit(150.0), F.lit(1e9)).alias("s"))
    assert cuts.select(F.transform("s", lambda x: rank.part_of(x, F.col("c")))).first()[0] == [0, 0, 1, 64, 150, 200]
    out = rank.with_running(big, ["run"], values=("n",), part_cells=100)
    assert out.filter("n_before <> score or n_all <> 30000").count() == 0


def test_no_row_carries_all_cuts(spark):
    """A group of very many parts: what lies beside a cell while its part is found stays short, and the parts are those of one long list."""
    cells = spark.range(3000).select(F.lit("a").alias("run"), (F.col("id") - 50).cast("double").alias("score")).union(spark.createDataFrame([("b", 1.0), ("a", float("nan"))], "run string, score double"))
    for n in (1, 63, 64, 65, 128, 2500):
        cuts = spark.createDataFrame([("a", [float(x) for x in range(n)], n)], "run string, _cuts array<double>, more int")
        out = rank.with_part(cells, cuts, ["run"], "score").collect()
        assert len(out) == 3002 and {(r._part, r.more) for r in out if r.run == "b"} == {(None, None)}
        assert all(r._part == sum(x < r.score or r.score != r.score for x in range(n)) for r in out if r.run == "a")
    widest = max(len(v) for r in rank.cut_runs(cuts, ["run"])[0].collect() + rank.cut_runs(cuts, ["run"])[1].collect() for v in [r["_cuts"]])
    assert widest < rank.CUTS_AT_ONCE
