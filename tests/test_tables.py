"""Records, joins, probes, and all queries against their SQL on the smallest tables."""

import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import gradelake.plans
from gradelake.operators import align, probe, report
from gradelake.plans.fixtures import Views
from gradelake.sources import records

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = gradelake.plans.all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents labels events lineitem embeddings conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(map(tuple, df.select(*names).collect())) == normal(got.fetchall())


def test_tokens_are_all_words_of_a_turn(spark, tmp_path):
    texts = {(1, 0): [f"w{i}" for i in range(300)], (1, 1): ["one"], (2, 0): [f"late{i}" for i in range(65)]}
    rows = [(c, t, " ".join(w)) for (c, t), w in texts.items()]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    said = ("Yes", "no", "NOTE", " yes*", "Y", "N", "YESTERDAY")
    want = {(c * 1000 + t, i): said[c % 7] if i % 5 == 1 else w for (c, t), ws in texts.items() for i, w in enumerate(ws, 1)}
    got = Views(spark, str(tmp_path)).tokens.collect()
    assert len(got) == len(want) and {(r.idx, r["rank"]): r.text for r in got} == want
    assert {r.text for r in QUERIES["classify_token"](spark, str(tmp_path)).collect()} == set(want.values())
    by_rule = {(r.rule, r["class"]): r.n_tokens for r in QUERIES["vocab_class_counts"](spark, str(tmp_path)).collect()}
    assert by_rule[("exact", "no")] == len({x for x in want.values() if x.strip().lower() in ("no", "n")})


def test_every_query_without_sql_is_a_model_or_a_simulation():
    assert set(QUERIES) - set(ORACLE) == {"paired_intervals", "main_metrics_intervals", "seed_aucs", "fit_mlp_ensemble", "sweep", "train_resample_auc"}


def test_broken_files_are_read(spark, tmp_path):
    good = {"idx": 1, "run": "a", "dataset": "gsm8k", "k_answers": ["1", None], "truncated": None, "error": "failed"}
    lines = [json.dumps(good), "", "   ", "[1]", "3", '{"run": "a"}', json.dumps(good | {"error": None}), json.dumps(good | {"idx": 2}), json.dumps(good | {"idx": 2, "gold_answer": "é"}), '{"idx": 7, "run"']
    (tmp_path / "raw.jsonl").write_text("\n".join(lines))
    every = records.read_lines(spark, str(tmp_path / "raw.jsonl"))
    assert every.count() == 8 and every.filter("malformed").count() == 4
    kept = {r.idx: r for r in records.dedupe_records(records.read_records(spark, str(tmp_path / "raw.jsonl"))).collect()}
    assert set(kept) == {1, 2} and kept[1].error is None and kept[2].gold_answer == "é" and kept[1].k_answers == ["1", None]
    stats = records.ingest_stats(every.withColumn("run", F.lit("x"))).first()
    assert (stats.n_lines, stats.n_malformed, stats.n_duplicate) == (8, 4, 2)


def test_written_records_come_back_in_order(spark, tmp_path):
    df = spark.range(50).select((49 - F.col("id")).alias("idx"), F.lit("v").alias("x"))
    for _ in range(2):
        records.write_records(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and sorted(r.idx for r in back.collect()) == list(range(50))


def test_samples_are_prefixes(spark):
    df = spark.createDataFrame([(f"p{i}", f"Level {i % 5 + 1}", "a" if i % 2 else "b") for i in range(60)], "problem string, level string, subject string")
    few, many = ([r.problem for r in records.sample_problems(df, n, 3).orderBy("idx").collect()] for n in (7, 100))
    assert many[:7] == few and len(many) == 60
    assert {r.level for r in records.sample_problems(df, 60, 3, levels=["3", "level4"]).collect()} == {"Level 3", "Level 4"}
    for bad in ({"levels": ["9"]}, {"subjects": ["z"]}):
        with pytest.raises(ValueError):
            records.sample_problems(df, 5, 1, **bad)


def test_majority_prefers_the_first_of_equals(spark):
    rows = [("r", 1, 0, "b"), ("r", 1, 1, "a"), ("r", 1, 2, "a"), ("r", 1, 3, "b"), ("r", 2, 0, None), ("r", 3, 0, None), ("r", 3, 1, "z"), ("r", 3, 2, None)]
    got = {r.idx: tuple(r)[2:] for r in report.majority_vote(spark.createDataFrame(rows, "run string, idx long, pos int, canonical string")).collect()}
    assert got == {1: ("b", 2, 4), 2: (None, None, 0), 3: ("z", 1, 1)}


def test_metadata_states(spark):
    schema = "run string, key string, value string"
    a = spark.createDataFrame([("r", "n_problems", "9"), ("r", "model", "m"), ("r", "label_policy", "1"), ("r", "seed", None)], schema)
    b = spark.createDataFrame([("r", "n_problems", "10"), ("r", "model", "x"), ("r", "label_policy", "2"), ("r", "seed", "1"), ("r", "extra", "e")], schema)
    forth = {r.key: r.status for r in align.compare_run_metadata(a, b).collect()}
    assert forth == {"n_problems": "grew", "model": "drift", "label_policy": "advisory", "seed": "missing", "extra": "missing"}
    assert {r.key: r.status for r in align.compare_run_metadata(b, a).collect()}["n_problems"] == "shrunk"


def activations(spark, n=240, seed=5):
    g = np.random.default_rng(seed)
    y = (g.random(n) < 0.5).astype(int)
    x = g.normal(size=(n, 2, 8))
    x[:, 1, :4] += 1.5 * y[:, None]
    rows = [(i, layer, int(y[i]), x[i, layer].tolist()) for i in range(n) for layer in (0, 1)]
    return spark.createDataFrame(rows, "idx long, layer int, y int, vec array<double>"), x, y


def test_heads_are_ranked_like_numpy(spark):
    df, x, y = activations(spark)
    heads = probe.explode_heads(df, 4)
    got = {r.flat_head: r.auc for r in probe.head_lda_auc(heads).collect()}
    for layer in (0, 1):
        for h in (0, 1):
            v = x[:, layer, 4 * h : 4 * h + 4]
            a, b = v[y == 1], v[y == 0]
            cov = sum((c - c.mean(0)).T @ (c - c.mean(0)) for c in (a, b)) / (len(v) - 2) + probe.RIDGE * np.eye(4)
            s = v @ np.linalg.solve(cov, a.mean(0) - b.mean(0))
            auc = np.mean(s[y == 1][:, None] > s[y == 0][None]) + np.mean(s[y == 1][:, None] == s[y == 0][None]) / 2
            assert got[2 * layer + h] == pytest.approx(max(auc, 1 - auc))
    best = probe.head_ranking(probe.head_lda_auc(heads), 1, 2, 4).first()
    assert (best.flat_head, best.layer, best.head_in_layer) == (2, 1, 0)
    assert probe.head_ranking(probe.head_lda_auc(heads), 1, None).first().layer is None
    assert {r.auc for r in probe.head_lda_auc(heads.withColumn("y", F.lit(1))).collect()} == {0.5}
    with pytest.raises(Exception, match="head_dim"):
        probe.explode_heads(df, 3).collect()


def test_models_rank_and_residuals_vanish(spark):
    df, x, y = activations(spark)
    flat = df.filter("layer = 1").select("idx", "y", F.col("vec").alias("features"), F.slice("vec", 1, 2).alias("shallow"))
    from gradelake.operators.rank import auroc

    for scored in (probe.fit_lr(flat, flat), probe.ensemble(probe.fit_mlp_ensemble(flat, flat, (0, 1)))):
        assert auroc(scored.withColumn("run", F.lit("r")), ["run"]).first().auroc > 0.85
    members = probe.fit_mlp_ensemble(flat, flat, (0, 1), 4, epochs=5)
    mean = {r.idx: r.score for r in probe.ensemble(members).collect()}
    pairs = members.groupBy("idx").agg(F.sum("score").alias("s"), F.count("score").alias("n")).collect()
    assert all(r.n == 2 and mean[r.idx] == pytest.approx(r.s / 2) for r in pairs)
    rest = np.array([r.features for r in probe.residualize(flat, flat).orderBy("idx").collect()])
    s = np.column_stack([np.ones(len(y)), x[:, 1, :2]])
    assert np.abs(s.T @ rest).max() < 1e-8
    assert probe.fit_lr(flat.filter("y = 1"), flat).select("score").distinct().collect()[0].score == 1.0


def test_detectors_by_name(spark):
    df, x, y = activations(spark, 120)
    flat = df.filter("layer = 1").select("idx", "y", F.col("vec").alias("features"), F.slice("vec", 5, 2).alias("shallow"))
    for d in ("lr_raw", "lr_controlled", "mlp_raw", "mlp_controlled"):
        s = probe.score_with(d, flat, flat, hidden=4, seeds=(0,), epochs=20)
        assert s.count() == 120 and s.filter("score < 0 or score > 1").count() == 0
    both = probe.fit_raw_and_controlled(flat, flat)
    assert {r.detector: r["count"] for r in both.groupBy("detector").count().collect()} == {"raw": 120, "controlled": 120}


def test_balancing(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "idx long, y int")
    n = {r.y: r["count"] for r in probe.balance_train(df, 1).groupBy("y").count().collect()}
    assert n == {0: 80, 1: 80}
    assert {r.idx for r in probe.balance_train(df, 1).filter("y = 0").collect()} == {i for i in range(100) if i % 5}
    assert probe.balance_train(df.filter("y = 1"), 1).count() == 20


def test_states_of_originals(spark):
    from gradelake.operators import perturb

    p = spark.createDataFrame([(" q1 ", "o1", 1), ("q2", "o1", 1), ("q3", "o2", 2), ("q4", "o3", 3), ("q5", "o4", 4), ("q5", "o4", 5)], "question string, original_question string, original_id int")
    ref = spark.createDataFrame([("o1", True), ("o2 ", True), ("o2", True), ("o4", False), ("o9", True)], "question string, labelable boolean")
    mapping = perturb.template_map(p)
    got = {r.original_question: (r.n_perturbed, r.n_reference, r.state) for r in perturb.match_originals(p, ref, mapping).collect()}
    assert got == {"o1": (2, 1, "matched"), "o2": (1, 2, "duplicated"), "o3": (1, 0, "missing"), "o4": (2, 1, "unlabelable")}
    assert [r.question for r in mapping.filter("violation").collect()] == ["q5"]


def test_prompts_differ_by_dataset_and_kind(spark):
    from gradelake.functions.prompts import KINDS, render_every_kind, template

    assert len({template(d, k) for d in ("gsm8k", "math") for k in KINDS}) == 10 and template("other", "judge") == template("gsm8k", "judge")
    df = spark.createDataFrame([("math", k, "P", None) for k in (*KINDS, "other")], "dataset string, kind string, problem string, phase1_solution string")
    got = {r.kind: r.prompt for r in render_every_kind(df).collect()}
    assert got["other"] is None and all("P" in got[k] and "boxed" in got[k] for k in KINDS)


def test_layers_refuse_another_width(spark, tmp_path):
    from gradelake.plans.fixtures import Views

    spark.createDataFrame([(1, [0.5] * 63, 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.raises(Exception, match="another width"):
        Views(spark, str(tmp_path)).layers.collect()
