"""Queries over scores: rank metrics, routing, verdict masses, resampling, probes and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import checks, perturb, probe, rank, report, resample, routing, verdict
from gradelake.plans.grading import EXACT, PREFIX
from gradelake.plans.registry import query

#: Row-level running counts of each run and detector: rows and wrong answers with a lower score, and with the same.
RANKED = """k AS (SELECT run, detector, score, count(*) AS n, sum(1 - y) AS w FROM scores GROUP BY ALL),
c AS (SELECT *, sum(n) OVER b AS cn, sum(w) OVER b AS cw, sum(n) OVER a AS tn, sum(w) OVER a AS tw FROM k
      WINDOW b AS (PARTITION BY run, detector ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run, detector)),
e AS (SELECT s.*, row_number() OVER (PARTITION BY s.run, s.detector ORDER BY s.score DESC, s.idx) AS i FROM scores s),
r AS (SELECT e.run, e.detector, e.i, ((tw - cw) + (i - (tn - cn)) * w::DOUBLE / n) / i AS risk FROM e JOIN c ON e.run = c.run AND e.detector = c.detector AND e.score = c.score)"""
METRICS = f"""WITH {RANKED},
m AS (SELECT run, detector, max(tn) AS n, max(tw) AS n_wrong, sum((n - w) * (cw - w + w / 2.0)) / nullif(max(tn - tw) * max(tw), 0)::DOUBLE AS auroc, sum(w * cw::DOUBLE / cn) / nullif(max(tw), 0) AS ap FROM c GROUP BY ALL),
u AS (SELECT run, detector, avg(risk) AS aurc FROM r GROUP BY ALL), f AS (SELECT * FROM m JOIN u USING (run, detector))"""


@query("rank_metrics", "run:s detector:s n:l n_wrong:l auroc:d ap:d aurc:d", "scores", f"{METRICS} SELECT * FROM f")
def _(v):
    return rank.rank_metrics(v.scores, ["run", "detector"])


@query("auroc", "run:s detector:s auroc:d", "scores", """
WITH p AS (SELECT run, detector, y, rank() OVER w + (count(*) OVER t - 1) / 2.0 AS r FROM scores WINDOW w AS (PARTITION BY run, detector ORDER BY score), t AS (PARTITION BY run, detector, score))
SELECT run, detector, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auroc FROM p GROUP BY run, detector""")  # fmt: skip
def _(v):
    return rank.auroc(v.scores, ["run", "detector"])


@query("auroc_in_buckets", "run:s auroc:d", "", """
WITH p AS (SELECT l_linestatus AS run, (l_returnflag <> 'R')::INT AS y, rank() OVER w + (count(*) OVER t - 1) / 2.0 AS r FROM lineitem
  WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_extendedprice), t AS (PARTITION BY l_linestatus, l_extendedprice))
SELECT run, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auroc FROM p GROUP BY run""")  # fmt: skip
def _(v):
    d = v.lineitem.select(F.col("l_linestatus").alias("run"), (F.col("l_returnflag") != "R").cast("int").alias("y"), F.col("l_extendedprice").alias("score"))
    return rank.auroc(d, ["run"], part_cells=1 << 14)


@query("saturated_metrics", "run:s n:l n_wrong:l auroc:d ap:d aurc:d", "", """
WITH k AS (SELECT l_linestatus AS run, l_discount AS score, count(*) AS n, sum((l_returnflag = 'R')::INT) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER b AS cn, sum(w) OVER b AS cw, sum(n) OVER a AS tn, sum(w) OVER a AS tw FROM k WINDOW b AS (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run)),
h AS (SELECT run, score, w, n, tn, tw, cn, cw, list_sum(list_transform(range((tn - cn + 1)::BIGINT, (tn - cn + n + 1)::BIGINT), lambda i: 1.0::DOUBLE / i)) AS h FROM c)
SELECT run, max(tn) AS n, max(tw) AS n_wrong, sum((n - w) * (cw - w + w / 2.0)) / (max(tn - tw) * max(tw))::DOUBLE AS auroc, sum(w * cw::DOUBLE / cn) / max(tw) AS ap,
  sum(w + ((tw - cw) - (tn - cn) * w::DOUBLE / n) * h) / max(tn) AS aurc FROM h GROUP BY run""")  # fmt: skip
def _(v):
    d = v.lineitem.select(F.col("l_linestatus").alias("run"), (F.col("l_returnflag") != "R").cast("int").alias("y"), F.col("l_discount").alias("score"))
    return rank.rank_metrics(d, ["run"])


@query("average_precision", "run:s detector:s ap:d", "scores", f"{METRICS} SELECT run, detector, ap FROM f")
def _(v):
    return rank.average_precision(v.scores, ["run", "detector"])


@query("aurc", "run:s detector:s aurc:d", "scores", f"{METRICS} SELECT run, detector, aurc FROM f")
def _(v):
    return rank.aurc(v.scores, ["run", "detector"])


@query("balanced_accuracy", "run:s balanced_accuracy:d", "items", """
SELECT run, (avg(CASE WHEN y = 1 THEN verdict_yes END) + avg(CASE WHEN y = 0 THEN 1 - verdict_yes END)) / 2 AS balanced_accuracy FROM items GROUP BY run""")  # fmt: skip
def _(v):
    return rank.balanced_accuracy(v.items, ["run"])


CURVE = """p AS (SELECT run, split, 1 - score_b AS s, y FROM items), t AS (SELECT DISTINCT run, split, s FROM p),
curve AS (SELECT t.run, t.split, t.s AS threshold, sum(1 - y)::DOUBLE / count(*) AS precision, sum(1 - y)::DOUBLE / (SELECT nullif(sum(1 - y), 0) FROM p z WHERE z.run = t.run AND z.split = t.split) AS recall
  FROM t JOIN p ON p.run = t.run AND p.split = t.split AND p.s >= t.s GROUP BY t.run, t.split, t.s)"""


def errors(v):
    return v.items.withColumn("error_score", 1 - F.col("score_b"))


@query("pr_curve", "run:s threshold:d precision:d recall:d", "items", f"WITH {CURVE} SELECT run, threshold, precision, recall FROM curve WHERE split = 'train'")
def _(v):
    return rank.pr_curve(errors(v).filter("split = 'train'"), ["run"])


GOAL = "goal AS (SELECT run, sum((1 - y) * (1 - verdict_yes))::DOUBLE / nullif(sum(1 - verdict_yes), 0) AS target FROM items WHERE split = 'train' GROUP BY run)"
THRESHOLD = f"{CURVE}, {GOAL}, thr AS (SELECT run, min(threshold) FILTER (WHERE precision >= target) AS threshold FROM curve JOIN goal USING (run) WHERE split = 'train' GROUP BY run)"


def goal(v):
    return rank.verdict_point(v.items.filter("split = 'train'"), ["run"]).select("run", F.col("precision").alias("target"))


def threshold(v):
    return rank.threshold_at_precision(errors(v).filter("split = 'train'"), goal(v), ["run"])


@query("threshold_at_precision", "run:s threshold:d", "items", f"WITH {THRESHOLD} SELECT run, threshold FROM thr")
def _(v):
    return threshold(v)


@query("operating_point", "run:s n_flagged:l recall:d precision:d", "items", f"""
WITH {THRESHOLD} SELECT run, CASE WHEN max(threshold) IS NOT NULL THEN count(*) FILTER (WHERE s >= threshold) END AS n_flagged,
  CASE WHEN max(threshold) IS NOT NULL THEN count(*) FILTER (WHERE s >= threshold AND y = 0)::DOUBLE / nullif(count(*) FILTER (WHERE y = 0), 0) END AS recall,
  CASE WHEN max(threshold) IS NOT NULL THEN count(*) FILTER (WHERE s >= threshold AND y = 0)::DOUBLE / nullif(count(*) FILTER (WHERE s >= threshold), 0) END AS precision FROM p JOIN thr USING (run) WHERE split = 'test' GROUP BY run""")  # fmt: skip
def _(v):
    return rank.operating_point(errors(v).filter("split = 'test'"), threshold(v), ["run"])


@query("verdict_point", "run:s recall:d precision:d says_yes_rate:d error_rate:d", "items", """
SELECT run, avg(CASE WHEN y = 0 THEN 1 - verdict_yes END) AS recall, avg(CASE WHEN verdict_yes = 0 THEN 1 - y END) AS precision, avg(verdict_yes) AS says_yes_rate, avg((verdict_yes <> y)::INT) AS error_rate FROM items GROUP BY run""")  # fmt: skip
def _(v):
    return rank.verdict_point(v.items, ["run"])


@query("oracle_recall", "run:s oracle_recall:d", "items", f"WITH {CURVE}, {GOAL} SELECT run, max(recall) FILTER (WHERE precision >= target) AS oracle_recall FROM curve JOIN goal USING (run) WHERE split = 'test' GROUP BY run")
def _(v):
    return rank.oracle_recall(errors(v).filter("split = 'test'"), goal(v), ["run"])


@query("error_detection", "run:s n:l n_wrong:l target:d threshold:d n_flagged:l recall:d recall_low:d recall_high:d precision:d oracle_recall:d judge_recall:d judge_precision:d recall_difference:d", "items", f"""
WITH {THRESHOLD}, held AS (SELECT i.*, 1 - score_b AS s, threshold FROM items i LEFT JOIN thr USING (run) WHERE split = 'test'),
a AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE y = 0)::DOUBLE AS n_wrong, max(threshold) AS threshold, count(*) FILTER (WHERE s >= threshold) AS f, count(*) FILTER (WHERE s >= threshold AND y = 0)::DOUBLE AS h,
  avg(CASE WHEN y = 0 THEN 1 - verdict_yes END) AS judge_recall, avg(CASE WHEN verdict_yes = 0 THEN 1 - y END) AS judge_precision FROM held GROUP BY run),
o AS (SELECT run, max(recall) FILTER (WHERE precision >= target) AS oracle_recall FROM curve JOIN goal USING (run) WHERE split = 'test' GROUP BY run),
r AS (SELECT a.*, goal.target, oracle_recall, CASE WHEN threshold IS NOT NULL THEN h / nullif(n_wrong, 0) END AS recall, CASE WHEN threshold IS NOT NULL THEN h / nullif(f, 0) END AS precision, 1.959963984540054 AS z FROM a LEFT JOIN goal USING (run) LEFT JOIN o USING (run))
SELECT run, n, n_wrong, target, threshold, CASE WHEN threshold IS NOT NULL THEN f END AS n_flagged, recall, precision, oracle_recall, judge_recall, judge_precision, recall - judge_recall AS recall_difference,
  greatest(0, least(recall, (recall + z * z / (2 * n_wrong) - z * sqrt(recall * (1 - recall) / n_wrong + z * z / (4 * n_wrong * n_wrong))) / (1 + z * z / n_wrong))) + 0 * recall AS recall_low,
  least(1, greatest(recall, (recall + z * z / (2 * n_wrong) + z * sqrt(recall * (1 - recall) / n_wrong + z * z / (4 * n_wrong * n_wrong))) / (1 + z * z / n_wrong))) + 0 * recall AS recall_high FROM r""")  # fmt: skip
def _(v):
    e = errors(v)
    return rank.error_detection(e.filter("split = 'train'"), e.filter("split = 'test'"), ["run"])


@query("wilson_interval", "run:s low:d high:d", "items", """
WITH p AS (SELECT run, count(*)::DOUBLE AS n, avg(y) AS p, 1.959963984540054 AS z FROM items GROUP BY run)
SELECT run, greatest(0, least(p, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))) AS low,
  least(1, greatest(p, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))) AS high FROM p""")  # fmt: skip
def _(v):
    g = v.items.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    low, high = rank.wilson_interval(F.col("k"), F.col("n"))
    return g.select("run", low.alias("low"), high.alias("high"))


BUDGET = f"""{RANKED}, b AS (SELECT unnest([0.02, 0.05, 0.075, 0.10, 0.125, 0.15, 0.20]::DOUBLE[]) AS budget),
q AS (SELECT c.*, budget, greatest(1, least(tn - 1, floor(budget * tn + 0.5)))::BIGINT AS reviewed FROM c, b),
g AS (SELECT run, detector, budget, reviewed, cw - w + (reviewed - (cn - n)) * w::DOUBLE / n AS caught, tn, tw FROM q WHERE cn - n < reviewed AND reviewed <= cn),
budgets AS (SELECT run, detector, budget, reviewed, caught / nullif(tw, 0) AS recall, (tw - caught) / nullif(tn - reviewed, 0) AS residual_risk FROM g)"""


@query("budget_metrics", "run:s detector:s budget:d reviewed:l recall:d residual_risk:d", "scores", f"WITH {BUDGET} SELECT * FROM budgets")
def _(v):
    return rank.budget_metrics(v.scores, ["run", "detector"])


@query("risk_coverage", "run:s detector:s score:d coverage:d risk:d", "scores", f"""
WITH {RANKED} SELECT run, detector, score, (tn - cn + n)::DOUBLE / tn AS coverage, (tw - cw + w)::DOUBLE / (tn - cn + n) AS risk FROM c""")  # fmt: skip
def _(v):
    return rank.risk_coverage(v.scores, ["run", "detector"])


@query("selective_error", "run:s detector:s coverage:d accepted:l risk:d", "scores", f"""
WITH {RANKED}, t AS (SELECT run, detector, max(tn) AS tn FROM c GROUP BY ALL), z AS (SELECT run, detector, unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5]::DOUBLE[]) AS coverage, tn FROM t)
SELECT z.run, z.detector, coverage, r.i AS accepted, risk FROM z JOIN r ON r.run = z.run AND r.detector = z.detector AND r.i = greatest(1, floor(coverage * tn))""")  # fmt: skip
def _(v):
    return rank.selective_error(v.scores, ["run", "detector"])


FLAGGED = """f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score_b, md5('3:' || CAST(idx AS VARCHAR)), idx) <= round_even(0.1 * count(*) OVER (PARTITION BY run), 0) AS flagged FROM items)"""


@query("flag_at_budget", "run:s idx:l flagged:b", "items", f"WITH {FLAGGED} SELECT run, idx, flagged FROM f")
def _(v):
    return rank.flag_at_budget(v.items, ["run"], "score_b", 3, share=0.1)


@query("flag_at_judge_rate", "run:s idx:l flagged:b", "items", """
SELECT run, idx, row_number() OVER (PARTITION BY run ORDER BY score_b, md5('4:' || CAST(idx AS VARCHAR)), idx) <= sum(1 - verdict_yes) OVER (PARTITION BY run) AS flagged FROM items""")  # fmt: skip
def _(v):
    return rank.flag_at_budget(v.items, ["run"], "score_b", 4, like=F.col("verdict_yes") == 0)


@query("flagged_metrics", "run:s n_flagged:l tp:l recall:d precision:d low:d high:d", "items", f"""
WITH {FLAGGED}, q AS (SELECT run, count(*) FILTER (WHERE flagged) AS n_flagged, count(*) FILTER (WHERE flagged AND y = 0) AS tp, count(*) FILTER (WHERE y = 0)::DOUBLE AS n, 1.96 AS z FROM f GROUP BY run),
p AS (SELECT *, tp / nullif(n, 0) AS p FROM q)
SELECT run, n_flagged, tp, p AS recall, tp / nullif(n_flagged, 0)::DOUBLE AS precision, CASE WHEN n > 0 THEN greatest(0, least(p, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))) END AS low,
  CASE WHEN n > 0 THEN least(1, greatest(p, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))) END AS high FROM p""")  # fmt: skip
def _(v):
    return rank.flagged_metrics(rank.flag_at_budget(v.items, ["run"], "score_b", 3, share=0.1), ["run"])


@query("level_breakdown", "run:s level:s n:l n_wrong:l prevalence:d auroc_probe:d auroc_judge:d difference:d", "scores", """
WITH p AS (SELECT run, level, detector, y, rank() OVER w + (count(*) OVER t - 1) / 2.0 AS r FROM scores WINDOW w AS (PARTITION BY run, level, detector ORDER BY score), t AS (PARTITION BY run, level, detector, score)),
a AS (SELECT run, level, detector, count(*) AS n, sum(1 - y) AS n_wrong, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auroc FROM p GROUP BY ALL)
SELECT a.run, a.level, a.n, a.n_wrong, a.n_wrong / a.n::DOUBLE AS prevalence, a.auroc AS auroc_probe, b.auroc AS auroc_judge, a.auroc - b.auroc AS difference FROM a JOIN a b ON a.run = b.run AND a.level = b.level AND a.detector = 'probe' AND b.detector = 'judge'""")  # fmt: skip
def _(v):
    return rank.level_breakdown(v.scores)


@query("budget_calibration", "q:d raw:l rounded:l", "items", """
WITH l AS (SELECT length, row_number() OVER (ORDER BY length) - 1 AS i, count(*) OVER () AS n FROM items), q AS (SELECT unnest([0.5, 0.95, 0.99, 0.999, 1.0]::DOUBLE[]) AS q),
z AS (SELECT q.q, l.length AS raw FROM q JOIN l ON q > 1 - 0.24 AND l.i = least(round_even((q - (1 - 0.24::DOUBLE)) / 0.24 * (n - 1), 0), n - 1))
SELECT q.q, raw, pow(2, ceil(log2(raw))) AS rounded FROM q LEFT JOIN z USING (q)""")  # fmt: skip
def _(v):
    return rank.budget_calibration(v.items, 0.24, (0.5, 0.95, 0.99, 0.999, 1.0))


@query("length_summary", "run:s n:l median:l p90:l p99:l max:l", "items", """
WITH l AS (SELECT run, list_sort(list(length)) AS v, count(*) AS n FROM items GROUP BY run) SELECT run, n, v[n // 2 + 1] AS median, v[floor(n * 0.9::DOUBLE)::BIGINT + 1] AS p90, v[floor(n * 0.99::DOUBLE)::BIGINT + 1] AS p99, v[n] AS max FROM l""")  # fmt: skip
def _(v):
    return rank.length_summary(v.items, by=("run",))


GAINS = """k AS (SELECT run, score, count(*) AS n, sum(major_ok - greedy_ok) AS g FROM routing GROUP BY ALL),
c AS (SELECT *, sum(n) OVER b AS cn, sum(g) OVER b AS cg, sum(n) OVER a AS tn, sum(g) OVER a AS tg FROM k WINDOW b AS (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run)),
t AS (SELECT run, avg(greedy_ok) AS greedy, avg(major_ok) AS major, count(*) AS n, count(*) FILTER (WHERE major_ok > greedy_ok) AS repairs, count(*) FILTER (WHERE major_ok < greedy_ok) AS breaks FROM routing GROUP BY run),
fr AS (SELECT i / 20.0::DOUBLE AS fraction FROM range(0, 21) x(i))"""
GAINED = "coalesce((SELECT cg - g + (m - (cn - n)) * g::DOUBLE / n FROM c WHERE c.run = q.run AND cn - n < m AND m <= cn), 0)"


@query("routed_accuracy", "run:s fraction:d m:l accuracy:d", "routing", f"""
WITH {GAINS}, q AS (SELECT run, fraction, n AS tn, greedy, round_even(fraction * n, 0)::BIGINT AS m FROM t, fr) SELECT run, fraction, m, greedy + {GAINED} / tn AS accuracy FROM q""")  # fmt: skip
def _(v):
    return routing.routed_accuracy(v.routing, ["run"])


@query("gain_over_random", "run:s fraction:d m:l gain_over_random:d", "routing", f"""
WITH {GAINS}, q AS (SELECT run, fraction, n AS tn, major - greedy AS mean, floor(fraction * n + 0.5)::BIGINT AS m FROM t, fr) SELECT run, fraction, m, {GAINED} / tn - m::DOUBLE / tn * mean AS gain_over_random FROM q""")  # fmt: skip
def _(v):
    return routing.gain_over_random(v.routing, ["run"])


@query("routing_baselines", "run:s fraction:d m:l repairs:l breaks:l route_all:d random_accuracy:d oracle_accuracy:d cost_replace:d cost_extra:d", "routing", f"""
WITH {GAINS}, o AS (SELECT run, major_ok - greedy_ok AS g, row_number() OVER (PARTITION BY run ORDER BY major_ok - greedy_ok DESC, idx) AS i FROM routing)
SELECT t.run, fraction, floor(fraction * t.n) AS m, repairs, breaks, major AS route_all, greedy + fraction * (major - greedy) AS random_accuracy,
  greedy + coalesce((SELECT sum(g) FROM o WHERE o.run = t.run AND o.i <= floor(fraction * t.n)), 0)::DOUBLE / t.n AS oracle_accuracy, 1 - fraction + fraction * 5 AS cost_replace, 1 + fraction * 5 AS cost_extra FROM t, fr""")  # fmt: skip
def _(v):
    return routing.routing_baselines(v.routing, ["run"])


@query("routing_peak", "run:s peak:d peak_fraction:d", "routing", f"""
WITH {GAINS}, q AS (SELECT run, fraction, n AS tn, greedy, round_even(fraction * n, 0)::BIGINT AS m FROM t, fr), a AS (SELECT run, fraction, greedy + {GAINED} / tn AS accuracy FROM q),
z AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(accuracy, 12) DESC, fraction) AS i FROM a) SELECT run, accuracy AS peak, fraction AS peak_fraction FROM z WHERE i = 1""")  # fmt: skip
def _(v):
    return routing.peak(routing.routed_accuracy(v.routing, ["run"]).withColumn("accuracy", F.round("accuracy", 12)), ["run"])


MASS = f"""k AS (SELECT *, {PREFIX} AS p, {EXACT} AS e FROM tokens)"""


def mass(rule: str, window: int | None) -> str:
    c, w = ("p" if rule == "prefix" else "e"), ("" if window is None else f"WHERE rank <= {window}")
    return f"""SELECT idx, '{rule}' AS rule, '{window or "full"}' AS window_, sum(CASE WHEN {c} = 'yes' THEN prob ELSE 0 END) AS yes_mass, sum(CASE WHEN {c} = 'no' THEN prob ELSE 0 END) AS no_mass, sum(CASE WHEN {c} IS NULL THEN prob ELSE 0 END) AS other_mass,
      coalesce(sum(CASE WHEN {c} = 'yes' THEN prob ELSE 0 END) / nullif(sum(CASE WHEN {c} IN ('yes', 'no') THEN prob ELSE 0 END), 0), 0.5) AS p_yes FROM k {w} GROUP BY idx"""


@query("verdict_mass", "idx:l yes_mass:d no_mass:d other_mass:d p_yes:d", "tokens", f"WITH {MASS} {mass('prefix', 20)}")
def _(v):
    return verdict.verdict_mass(v.tokens)


@query("misbinned_records", "n_touched:l mean_mass:d max_mass:d total_mass:d", "tokens", f"""
WITH {MASS}, m AS (SELECT idx, sum(CASE WHEN p = 'no' AND e IS NULL AND rank <= 40 THEN prob ELSE 0 END) AS mass FROM k GROUP BY idx)
SELECT count(*) FILTER (WHERE mass > 1e-4) AS n_touched, avg(mass) AS mean_mass, max(mass) AS max_mass, sum(mass) AS total_mass FROM m""")  # fmt: skip
def _(v):
    return verdict.misbinned_records(v.tokens, "no")


@query("misbinned_tokens", "text:s n:l total_mass:d", "tokens", f"""
WITH {MASS} SELECT text, count(*) AS n, sum(prob) AS total_mass FROM k WHERE p = 'no' AND e IS NULL AND rank <= 40 GROUP BY text ORDER BY round(sum(prob), 9) DESC, text LIMIT 20""")  # fmt: skip
def _(v):
    return verdict.misbinned_tokens(v.tokens, "no")


@query("vocab_class_counts", "rule:s class:s n_tokens:l", "tokens", f"""
WITH d AS (SELECT DISTINCT text FROM tokens), k AS (SELECT text, {PREFIX} AS p, {EXACT} AS e FROM d)
SELECT 'prefix' AS rule, p AS class, count(*) AS n_tokens FROM k WHERE p IS NOT NULL GROUP BY p UNION ALL SELECT 'exact', e, count(*) FROM k WHERE e IS NOT NULL GROUP BY e""")  # fmt: skip
def _(v):
    return verdict.vocab_class_counts(v.tokens.select("text").distinct())


def judged(v):
    turns = v.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), (F.length("text") % 3 != 0).cast("int").alias("y"), F.when(F.col("conv_id") % 2 == 0, "train").otherwise("test").alias("split"))
    return turns


JUDGED = "j AS (SELECT conv_id * 1000 + turn AS idx, (length(text) % 3 <> 0)::INT AS y, CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM conversations)"


@query("compare_verdict_rules", "rule:s top:s n:l auroc:d ap:d n_saturated:l n_fallback:l n_moved:l threshold:d recall:d recall_low:d recall_high:d precision:d", "tokens", f"""
WITH {MASS}, {JUDGED}, a AS ({" UNION ALL ".join(mass(r, w) for r in ("prefix", "exact") for w in (20, 40, None))}),
d AS (SELECT a.rule, a.window_, a.idx, round(a.p_yes, 12) AS p_yes, j.y, j.split, b.p_yes AS base FROM a JOIN j USING (idx) JOIN a b ON b.idx = a.idx AND b.rule = 'prefix' AND b.window_ = '20'),
q AS (SELECT *, rank() OVER w + (count(*) OVER t - 1) / 2.0 AS r FROM d WHERE split = 'test' WINDOW w AS (PARTITION BY rule, window_ ORDER BY p_yes), t AS (PARTITION BY rule, window_, p_yes)),
g AS (SELECT rule, window_, p_yes, count(*) AS n, sum(1 - y) AS w FROM d WHERE split = 'train' GROUP BY ALL),
h AS (SELECT rule, window_, p_yes, sum(w) OVER z / (sum(n) OVER z)::DOUBLE AS precision FROM g WINDOW z AS (PARTITION BY rule, window_ ORDER BY p_yes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
thr AS (SELECT rule, window_, max(p_yes) FILTER (WHERE precision >= 0.3) AS p FROM h GROUP BY ALL),
tg AS (SELECT rule, window_, p_yes, count(*) AS n, sum(1 - y) AS w FROM d WHERE split = 'test' GROUP BY ALL),
ta AS (SELECT rule, window_, sum(w * cw / cn) / sum(w) AS ap FROM (SELECT *, sum(w) OVER z AS cw, (sum(n) OVER z)::DOUBLE AS cn FROM tg WINDOW z AS (PARTITION BY rule, window_ ORDER BY p_yes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x GROUP BY ALL),
report AS (SELECT q.rule, q.window_ AS top, any_value(ap) AS ap, count(*) FILTER (WHERE y = 0)::DOUBLE AS nw, 1.959963984540054 AS z, count(*) AS n, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auroc, count(*) FILTER (WHERE p_yes <= 0.02 OR p_yes >= 0.98) AS n_saturated,
  count(*) FILTER (WHERE p_yes = 0.5) AS n_fallback, count(*) FILTER (WHERE abs(p_yes - base) > 1e-3) AS n_moved, 1 - max(p) AS threshold,
  CASE WHEN max(p) IS NOT NULL THEN count(*) FILTER (WHERE p_yes <= p AND y = 0)::DOUBLE / count(*) FILTER (WHERE y = 0) END AS recall,
  CASE WHEN max(p) IS NOT NULL THEN count(*) FILTER (WHERE p_yes <= p AND y = 0)::DOUBLE / nullif(count(*) FILTER (WHERE p_yes <= p), 0) END AS precision
FROM q LEFT JOIN thr ON thr.rule = q.rule AND thr.window_ = q.window_ JOIN ta ON ta.rule = q.rule AND ta.window_ = q.window_ GROUP BY q.rule, q.window_)
SELECT *, greatest(0, least(recall, (recall + z * z / (2 * nw) - z * sqrt(recall * (1 - recall) / nw + z * z / (4 * nw * nw))) / (1 + z * z / nw))) + 0 * recall AS recall_low,
  least(1, greatest(recall, (recall + z * z / (2 * nw) + z * sqrt(recall * (1 - recall) / nw + z * z / (4 * nw * nw))) / (1 + z * z / nw))) + 0 * recall AS recall_high FROM report""")  # fmt: skip
def _(v):
    return verdict.compare_verdict_rules(v.tokens, judged(v), target=0.3).withColumnRenamed("window", "top")


def draws(seed: int, n_boot: int, table: str, unit: str, stratum: str | None = None) -> str:
    """SQL of `bootstrap_weights` by run: replicate, unit, w."""
    part, label = (f"run, {stratum}", f"CAST({stratum} AS VARCHAR)") if stratum else ("run", "'all'")
    pick = ", ".join(["run", *([stratum] if stratum else [])])
    return f"""SELECT u.run, d.b, u.{unit}, count(*) AS w FROM (SELECT *, count(*) OVER (PARTITION BY {part}) AS n, row_number() OVER (PARTITION BY {part} ORDER BY md5(CAST({unit} AS VARCHAR)), {unit}) - 1 AS i FROM (SELECT DISTINCT {pick}, {unit} FROM {table}) x0) u
  JOIN (SELECT {pick}, b, ('0x' || substr(md5('{seed}:' || CAST(b AS VARCHAR) || ':' || {label} || ':' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % n AS i
        FROM (SELECT *, count(*) OVER (PARTITION BY {part}) AS n, row_number() OVER (PARTITION BY {part} ORDER BY md5(CAST({unit} AS VARCHAR)), {unit}) - 1 AS i FROM (SELECT DISTINCT {pick}, {unit} FROM {table}) x1) y, (SELECT unnest(range(0, {n_boot})) AS b) z) d
  USING ({pick}, i) GROUP BY u.run, d.b, u.{unit}"""


def weighted_auroc(score: str, source: str, keys: str = "run, b") -> str:
    """SQL of the weighted AUROC of `source` (keys, score, y, w)."""
    return f"""SELECT {keys}, sum(p * (cw - q + q / 2.0)) / nullif(sum(p) * sum(q), 0)::DOUBLE AS auroc FROM (SELECT *, sum(q) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw
      FROM (SELECT {keys}, {score} AS s, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM {source} GROUP BY {keys}, {score}) x2) x3 GROUP BY {keys}"""


@query("bootstrap_weights", "run:s b:l idx:l w:l", "items", draws(11, 5, "items", "idx", "y"))
def _(v):
    return resample.bootstrap_weights(v.items, 5, 11, strata="y")


def weighted_metrics(score: str) -> str:
    """SQL of auroc, ap and aurc of d (run, b, score, y, w): the last by a running sum over every copy of a row, each with the mean risk of its tie."""
    return f"""SELECT run, b, sum(p * (cw - q + q / 2.0)) / nullif(sum(p) * sum(q), 0)::DOUBLE AS auroc, sum(q * cw::DOUBLE / cn) / nullif(sum(q), 0) AS ap,
      sum(list_sum(list_transform(range(1, n::BIGINT + 1), lambda i: ((tw - cw) + i * q::DOUBLE / n) / ((tn - cn) + i)))) / max(tn) AS aurc
      FROM (SELECT *, sum(q) OVER o AS cw, sum(n) OVER o AS cn, sum(q) OVER a AS tw, sum(n) OVER a AS tn FROM (SELECT run, b, {score} AS s, sum(w) AS n, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM d GROUP BY ALL) x8
        WINDOW o AS (PARTITION BY run, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run, b)) x9 GROUP BY run, b"""


@query("paired_bootstrap", "run:s b:l auroc:d ap:d aurc:d", "items", f"""
WITH w AS ({draws(11, 8, "items", "idx", "y")}), d AS (SELECT items.*, w.b, w.w FROM items JOIN w USING (run, idx)), a AS ({weighted_metrics("score_a")}), c AS ({weighted_metrics("score_b")})
SELECT run, b, a.auroc - c.auroc AS auroc, a.ap - c.ap AS ap, a.aurc - c.aurc AS aurc FROM a JOIN c USING (run, b)""")  # fmt: skip
def _(v):
    return resample.paired_bootstrap(v.items, "score_a", "score_b", 8, 11)


def weighted_budgets(score: str) -> str:
    """SQL of the weighted budget metrics of d (run, b, score, y, w) at 5 and 20 per cent."""
    return f"""SELECT run, b, budget, (cw - q + (m - (cn - n)) * q::DOUBLE / n) / nullif(tw, 0) AS recall, (tw - (cw - q + (m - (cn - n)) * q::DOUBLE / n)) / nullif(tn - m, 0) AS risk FROM (
      SELECT *, greatest(1, least(tn - 1, floor(budget * tn + 0.5))) AS m FROM (SELECT *, sum(n) OVER o AS cn, sum(q) OVER o AS cw, sum(n) OVER a AS tn, sum(q) OVER a AS tw
        FROM (SELECT run, b, {score} AS s, sum(w) AS n, sum(w * (1 - y)) AS q FROM d GROUP BY ALL) x4 WINDOW o AS (PARTITION BY run, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run, b)) x5,
      (SELECT unnest([0.05, 0.2]::DOUBLE[]) AS budget) x6) x7 WHERE cn - n < m AND m <= cn"""


@query("paired_budget_bootstrap", "run:s b:l budget:d recall:d residual_risk:d", "items", f"""
WITH w AS ({draws(11, 6, "items", "idx", "y")}), d AS (SELECT items.*, w.b, w.w FROM items JOIN w USING (run, idx)), x AS ({weighted_budgets("score_a")}), z AS ({weighted_budgets("score_b")})
SELECT run, b, budget, x.recall - z.recall AS recall, x.risk - z.risk AS residual_risk FROM x JOIN z USING (run, b, budget)""")  # fmt: skip
def _(v):
    return resample.paired_budget_bootstrap(v.items, "score_a", "score_b", 6, 11, budgets=(0.05, 0.2))


@query("poisson_weights", "run:s b:l template:s w:l", "items", """
WITH u AS (SELECT DISTINCT run, template, b FROM items, (SELECT unnest(range(0, 4)) AS b) z), h AS (SELECT *, (('0x' || substr(md5('19:' || CAST(b AS VARCHAR) || ':' || template), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM u),
c AS (SELECT *, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]::DOUBLE[], lambda x: x < u)) AS w FROM h)
SELECT run, b, template, w FROM c WHERE w > 0""")  # fmt: skip
def _(v):
    return resample.poisson_weights(v.items, 4, 19, "template")


@query("paired_recall_bootstrap", "run:s b:l difference:d", "items", f"""
WITH w AS ({draws(12, 8, "items", "idx")}) SELECT run, b, (sum(w * (1 - y) * (score_b <= 0.3)::INT) - sum(w * (1 - y) * (1 - verdict_yes)))::DOUBLE / nullif(sum(w * (1 - y)), 0) AS difference FROM items JOIN w USING (run, idx) GROUP BY run, b""")  # fmt: skip
def _(v):
    d = v.items.withColumns({"flag_a": F.col("score_b") <= 0.3, "flag_b": F.col("verdict_yes") == 0})
    return resample.paired_recall_bootstrap(d, "flag_a", "flag_b", 8, 12)


CLUSTERED = f"w AS ({draws(13, 8, 'items', 'template')}), d AS (SELECT items.*, w.b, w.w FROM items JOIN w USING (run, template))"


@query("cluster_bootstrap", "run:s b:l difference:d", "items", f"WITH {CLUSTERED}, a AS ({weighted_auroc('score_a', 'd')}), c AS ({weighted_auroc('score_b', 'd')}) SELECT run, b, a.auroc - c.auroc AS difference FROM a JOIN c USING (run, b)")
def _(v):
    return resample.cluster_bootstrap(v.items, "score_a", "score_b", "template", 8, 13)


@query("two_sample_delta", "run:s b:l difference:d", "items", f"""
WITH perturbed AS (SELECT * FROM items WHERE split = 'test'), reference AS (SELECT * FROM items WHERE split = 'train'), wp AS ({draws(14, 6, "perturbed", "template")}), wr AS ({draws(15, 6, "reference", "idx")}),
p AS (SELECT perturbed.*, b, w FROM perturbed JOIN wp USING (run, template)), r AS (SELECT reference.*, b, w FROM reference JOIN wr USING (run, idx)),
a AS ({weighted_auroc("score_a", "p")}), c AS ({weighted_auroc("score_a", "r")}), a2 AS ({weighted_auroc("score_b", "p")}), c2 AS ({weighted_auroc("score_b", "r")})
SELECT run, b, (a.auroc - c.auroc) - (a2.auroc - c2.auroc) AS difference FROM a JOIN c USING (run, b) JOIN a2 USING (run, b) JOIN c2 USING (run, b)""")  # fmt: skip
def _(v):
    return resample.two_sample_delta(v.items.filter("split = 'test'"), v.items.filter("split = 'train'"), "score_a", 6, 14, minus="score_b")


def weighted_gains(score: str) -> str:
    """SQL of the gain over random of d (run, b, score, greedy_ok, major_ok, w) at three fractions."""
    cells = f"""SELECT *, sum(n) OVER x AS cn, sum(g) OVER x AS cg, sum(n) OVER a AS tn, sum(g) OVER a AS tg FROM (SELECT run, b, {score} AS s, sum(w) AS n, sum(w * (major_ok - greedy_ok)) AS g FROM d GROUP BY ALL) k
      WINDOW x AS (PARTITION BY run, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run, b)"""
    return f"""SELECT q.run, q.b, fraction, coalesce((SELECT cg - g + (m - (cn - n)) * g::DOUBLE / n FROM ({cells}) c WHERE c.run = q.run AND c.b = q.b AND cn - n < m AND m <= cn), 0) / tn - m / tn * tg / tn AS gain_over_random
      FROM (SELECT DISTINCT run, b, tn, tg, f AS fraction, floor(f * tn + 0.5) AS m FROM ({cells}) c, (SELECT unnest([0.1, 0.3, 0.5]::DOUBLE[]) AS f) z) q"""


ROUTED = f"WITH w AS ({draws(16, 4, 'routing', 'idx')}), d AS (SELECT routing.*, (idx * 37) % 10 / 10.0 AS other, b, w FROM routing JOIN w USING (run, idx))"


@query("routing_gain_bootstrap", "run:s b:l fraction:d gain_over_random:d", "routing", f"{ROUTED} {weighted_gains('score')}")
def _(v):
    return resample.routing_gain_bootstrap(v.routing, 4, 16, fractions=(0.1, 0.3, 0.5))


@query("routing_gain_difference", "run:s b:l fraction:d difference:d", "routing", f"""
{ROUTED}, x AS ({weighted_gains("score")}), z AS ({weighted_gains("other")}) SELECT run, b, fraction, x.gain_over_random - z.gain_over_random AS difference FROM x JOIN z USING (run, b, fraction)""")  # fmt: skip
def _(v):
    d = v.routing.withColumn("other", F.pmod(F.col("idx") * 37, F.lit(10)) / 10)
    return resample.routing_gain_difference(d, "score", "other", 4, 16, fractions=(0.1, 0.3, 0.5))


PAIRS = "pairs AS (SELECT 'all' AS run, template, a - b AS delta FROM (SELECT template, avg(y) AS a FROM items WHERE dataset = 'math' GROUP BY template) x JOIN (SELECT template, avg(y) AS b FROM items WHERE dataset = 'gsm8k' GROUP BY template) z USING (template))"


@query("template_delta_bootstrap", "b:l mean_delta:d", "items", f"WITH {PAIRS}, w AS ({draws(17, 10, 'pairs', 'template')}) SELECT b, sum(delta * w) / sum(w) AS mean_delta FROM pairs JOIN w USING (run, template) GROUP BY b")
def _(v):
    pairs = perturb.template_accuracy(v.items.filter("dataset = 'math'"), v.items.filter("dataset = 'gsm8k'")).withColumn("run", F.lit("all"))
    return resample.template_delta_bootstrap(pairs, 10, 17, by=("run",))


@query("percentile_ci", "run:s n_draws:l mean:d low:d high:d excludes_zero:b", "items", f"""
WITH w AS ({draws(12, 200, "items", "idx")}), t AS (SELECT run, b, (sum(w * (1 - y) * (score_b <= 0.3)::INT) - sum(w * (1 - y) * (1 - verdict_yes)))::DOUBLE / nullif(sum(w * (1 - y)), 0) AS d FROM items JOIN w USING (run, idx) GROUP BY run, b)
SELECT run, count(d) AS n_draws, avg(d) AS mean, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM t GROUP BY run""")  # fmt: skip
def _(v):
    d = v.items.withColumns({"flag_a": F.col("score_b") <= 0.3, "flag_b": F.col("verdict_yes") == 0})
    return resample.percentile_ci(resample.paired_recall_bootstrap(d, "flag_a", "flag_b", 200, 12), "difference", ("run",))


@query("bootstrap_intervals", "run:s metric:s n_draws:l mean:d low:d high:d excludes_zero:b", "items", f"""
WITH w AS ({draws(11, 20, "items", "idx", "y")}), d AS (SELECT items.*, w.b, w.w FROM items JOIN w USING (run, idx)), a AS ({weighted_metrics("score_a")}), c AS ({weighted_metrics("score_b")}),
x AS ({weighted_budgets("score_a")}), z AS ({weighted_budgets("score_b")}), l AS (SELECT run, unnest(['auroc', 'ap', 'aurc']) AS metric, unnest([a.auroc - c.auroc, a.ap - c.ap, a.aurc - c.aurc]) AS v FROM a JOIN c USING (run, b)
  UNION ALL SELECT run, unnest(['recall_', 'residual_risk_']) || budget AS metric, unnest([x.recall - z.recall, x.risk - z.risk]) AS v FROM x JOIN z USING (run, b, budget))
SELECT run, metric, count(v) AS n_draws, avg(v) AS mean, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, quantile_cont(v, 0.025) > 0 OR quantile_cont(v, 0.975) < 0 AS excludes_zero FROM l GROUP BY run, metric""")  # fmt: skip
def _(v):
    one = lambda name, c: F.struct(name.alias("metric"), F.col(c).alias("value"))
    whole = resample.paired_bootstrap(v.items, "score_a", "score_b", 20, 11)
    at = resample.paired_budget_bootstrap(v.items, "score_a", "score_b", 20, 11, budgets=(0.05, 0.2))
    long = whole.select("run", F.explode(F.array(*[one(F.lit(m), m) for m in ("auroc", "ap", "aurc")])).alias("pair"))
    budget = lambda m: F.concat(F.lit(f"{m}_"), F.col("budget").cast("string"))
    long = long.union(at.select("run", F.explode(F.array(*[one(budget(m), m) for m in ("recall", "residual_risk")])).alias("pair")))
    return resample.percentile_ci(long.select("run", "pair.*"), "value", ("run", "metric"))


@query("paired_intervals", "run:s metric:s mean:d low:d high:d", "items")
def _(v):
    d = resample.paired_intervals(v.items, "score_a", "score_b", 2000, 1)
    names = resample.metric_names(rank.BUDGETS)
    long = d.select("run", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])).alias("x")).select("run", "x.*")
    return resample.percentile_ci(long.filter(~F.isnan("value")), "value", ("run", "metric"))


@query("main_metrics", "run:s n:l n_wrong:l prevalence:d probe_auroc:d judge_auroc:d auroc_difference:d probe_ap:d judge_ap:d ap_difference:d probe_aurc:d judge_aurc:d aurc_difference:d", "scores", f"""
{METRICS} SELECT a.run, a.n, a.n_wrong, a.n_wrong / a.n::DOUBLE AS prevalence, a.auroc AS probe_auroc, b.auroc AS judge_auroc, a.auroc - b.auroc AS auroc_difference, a.ap AS probe_ap, b.ap AS judge_ap, a.ap - b.ap AS ap_difference,
  a.aurc AS probe_aurc, b.aurc AS judge_aurc, a.aurc - b.aurc AS aurc_difference FROM f a JOIN f b ON a.run = b.run AND a.detector = 'probe' AND b.detector = 'judge'""")  # fmt: skip
def _(v):
    return checks.main_metrics(v.scores)


@query("main_metrics_intervals", "run:s auroc_difference:d auroc_low:d auroc_high:d ap_low:d ap_high:d aurc_low:d aurc_high:d", "scores")
def _(v):
    return checks.with_intervals(checks.main_metrics(v.scores), resample.paired_intervals(v.items, "score_a", "score_b", 2000, 1))


@query("fixed_budget_table", "run:s budget:d reviewed:l probe_recall:d judge_recall:d recall_gain:d probe_residual_risk:d judge_residual_risk:d risk_gain:d", "scores", f"""
WITH {BUDGET} SELECT a.run, a.budget, a.reviewed, a.recall AS probe_recall, b.recall AS judge_recall, a.recall - b.recall AS recall_gain, a.residual_risk AS probe_residual_risk, b.residual_risk AS judge_residual_risk,
  b.residual_risk - a.residual_risk AS risk_gain FROM budgets a JOIN budgets b ON a.run = b.run AND a.budget = b.budget AND a.detector = 'probe' AND b.detector = 'judge'""")  # fmt: skip
def _(v):
    return checks.fixed_budget_table(v.scores)


@query("check_risk_identity", "run:s n_budgets:l max_discrepancy:d", "scores", f"""
WITH {BUDGET}, p AS (SELECT run, detector, max(tw)::DOUBLE / max(tn) AS prevalence, max(tn) AS n FROM c GROUP BY ALL)
SELECT a.run, count(*) AS n_budgets, max(abs((b.residual_risk - a.residual_risk) - p.prevalence * (a.recall - b.recall) / (1 - a.reviewed::DOUBLE / p.n))) AS max_discrepancy
FROM budgets a JOIN budgets b ON a.run = b.run AND a.budget = b.budget AND a.detector = 'probe' AND b.detector = 'judge' JOIN p ON p.run = a.run AND p.detector = 'probe' GROUP BY a.run""")  # fmt: skip
def _(v):
    return checks.check_risk_identity(checks.fixed_budget_table(v.scores), checks.main_metrics(v.scores))


@query("check_risk_identity_of_other_scores", "run:s n_budgets:l max_discrepancy:d", "scores", f"""
WITH {BUDGET}, p AS (SELECT run, detector, max(tw)::DOUBLE / max(tn) AS prevalence, max(tn) AS n FROM c GROUP BY ALL)
SELECT a.run, count(*) AS n_budgets, max(abs((b.residual_risk - a.residual_risk) - 2 * p.prevalence * (a.recall - b.recall) / (1 - a.reviewed::DOUBLE / p.n))) AS max_discrepancy
FROM budgets a JOIN budgets b ON a.run = b.run AND a.budget = b.budget AND a.detector = 'probe' AND b.detector = 'judge' JOIN p ON p.run = a.run AND p.detector = 'probe' GROUP BY a.run""")  # fmt: skip
def _(v):
    # a report whose prevalence is wrong: the check must say by how much
    return checks.check_risk_identity(checks.fixed_budget_table(v.scores), checks.main_metrics(v.scores).withColumn("prevalence", 2 * F.col("prevalence")))


@query("check_auroc_identity", "run:s detector:s mean_recall:d from_auroc:d discrepancy:d", "scores", f"""
WITH {RANKED}, m AS (SELECT run, detector, sum((n - w) * (cw - w + w / 2.0)) / nullif(max(tn - tw) * max(tw), 0)::DOUBLE AS auroc, max(tw)::DOUBLE / max(tn) AS p, max(tn) AS n FROM c GROUP BY ALL),
v AS (SELECT run, detector, sum(list_sum(list_transform(range(1, n + 1), lambda i: cw - w + i * w::DOUBLE / n))) / nullif(max(tw), 0) / max(tn) AS mean_recall FROM c GROUP BY ALL)
SELECT run, detector, mean_recall, p / 2 + (1 - p) * auroc + 1 / (2.0 * n) AS from_auroc, abs(mean_recall - (p / 2 + (1 - p) * auroc + 1 / (2.0 * n))) AS discrepancy FROM m JOIN v USING (run, detector)""")  # fmt: skip
def _(v):
    return checks.check_auroc_identity(v.scores, ["run", "detector"])


@query("check_routing_identity", "run:s max_discrepancy:d", "routing", f"""
WITH {GAINS}, i AS (SELECT run, major_ok - greedy_ok AS g, row_number() OVER (PARTITION BY run ORDER BY major_ok - greedy_ok DESC, idx) AS i FROM routing),
a AS (SELECT t.run, fraction, n, greedy + coalesce((SELECT sum(g) FROM i WHERE i.run = t.run AND i.i <= floor(fraction * t.n)), 0)::DOUBLE / n AS items, greedy + (least(floor(fraction * n), repairs) - greatest(0, floor(fraction * n) - (n - breaks))) / n AS closed FROM t, fr)
SELECT run, max(abs(items - closed)) AS max_discrepancy FROM a GROUP BY run""")  # fmt: skip
def _(v):
    return checks.check_routing_identity(v.routing, ["run"])


@query("compare_metric_tables", "run:s metric:s new_value:d old_value:d difference:d status:s", "items", """
WITH n AS (SELECT run, unnest(['n', 'y', 'a']) AS metric, count(*) AS n, avg(y) AS y, avg(score_a) AS a FROM items GROUP BY run), v AS (SELECT run, metric, CASE metric WHEN 'n' THEN n WHEN 'y' THEN y ELSE a END::DOUBLE AS x FROM n),
o AS (SELECT run, metric, CASE WHEN run = 'fr' AND metric = 'n' THEN x + 1 WHEN run = 'de' AND metric = 'y' THEN x + 0.5 ELSE x END AS z FROM v WHERE NOT (run = 'es' AND metric = 'a'))
SELECT run, metric, x AS new_value, z AS old_value, x - z AS difference, CASE WHEN z IS NULL THEN 'only_new' WHEN x = z THEN 'ok' ELSE 'differs' END AS status FROM v LEFT JOIN o USING (run, metric)""")  # fmt: skip
def _(v):
    g = v.items.groupBy("run").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("y"), F.avg("score_a").alias("a"))
    new = g.select("run", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("n", "y", "a")])).alias("x")).select("run", "x.*")
    off = F.when((F.col("run") == "fr") & (F.col("metric") == "n"), 1.0).when((F.col("run") == "de") & (F.col("metric") == "y"), 0.5).otherwise(0.0)
    old = new.filter("not (run = 'es' and metric = 'a')").withColumn("value", F.col("value") + off)
    return report.compare_metric_tables(new, old)


@query("sweep_spans", "run:s axis:s min_probe:d max_probe:d min_gap:d max_gap:d all_positive:b", "items", """
WITH r AS (SELECT run, CASE WHEN level = 'Level 1' THEN 'default' ELSE 'axis' || CAST(idx % 2 AS VARCHAR) END AS axis, score_a AS probe, score_a - score_b AS gap FROM items),
a AS (SELECT DISTINCT run, axis FROM r WHERE axis <> 'default'), e AS (SELECT * FROM r WHERE axis <> 'default' UNION ALL SELECT r.run, a.axis, r.probe, r.gap FROM r JOIN a ON r.run = a.run WHERE r.axis = 'default')
SELECT run, axis, min(probe) AS min_probe, max(probe) AS max_probe, min(gap) AS min_gap, max(gap) AS max_gap, bool_and(gap > 0) AS all_positive FROM e GROUP BY run, axis""")  # fmt: skip
def _(v):
    axis = F.when(F.col("level") == "Level 1", "default").otherwise(F.concat(F.lit("axis"), F.col("idx") % 2))
    rows = v.items.select("run", axis.alias("axis"), F.col("score_a").alias("probe"), (F.col("score_a") - F.col("score_b")).alias("gap"))
    return checks.sweep_spans(rows, ("probe", "gap"))


@query("merge_sweeps", "run:s state:s", "items", """
SELECT run, CASE run WHEN 'en' THEN 'conflict' ELSE 'ok' END AS state FROM items WHERE run <> 'fr' GROUP BY run UNION ALL SELECT run, 'missing' FROM items WHERE run = 'fr' GROUP BY run""")  # fmt: skip
def _(v):
    parts = v.items.filter("run <> 'fr'").select("run", F.col("level").alias("axis"), F.col("split").alias("cell"), F.when(F.col("run") == "en", F.col("idx") % 2).otherwise(1).alias("value"))
    return checks.merge_sweeps(parts, v.items.select("run").distinct())


# probes: activations are the embeddings, two layers of four heads with eight numbers each


def heads(v):
    return probe.explode_heads(v.layers, 8)


@query("explode_heads", "idx:l flat_head:l y:l first:d last:d", "heads", "SELECT idx, flat_head, y, vec[1] AS first, vec[8] AS last FROM heads")
def _(v):
    return heads(v).select("idx", "flat_head", "y", F.col("vec")[0].alias("first"), F.col("vec")[7].alias("last"))


@query("vector_quality", "layer:l n_vectors:l n_not_finite:l peak:d n_beyond:l", "", """
WITH h AS (SELECT vec_id, embedding[1:32] AS v, 0 AS layer FROM embeddings UNION ALL SELECT vec_id, embedding[33:64], 1 FROM embeddings),
s AS (SELECT vec_id, layer, v[1]::DOUBLE * CASE WHEN (vec_id + layer) % 11 = 0 THEN 1e9 ELSE 1 END AS a, CASE WHEN (vec_id + layer) % 7 = 0 THEN NULL ELSE v[2]::DOUBLE END AS b, CASE WHEN (vec_id + layer) % 13 = 0 THEN NULL ELSE v[3]::DOUBLE END AS c, v[4:32]::DOUBLE[] AS rest FROM h),
p AS (SELECT layer, (b IS NULL)::INT + (c IS NULL)::INT AS bad, greatest(abs(a), coalesce(abs(b), 0), coalesce(abs(c), 0), list_max(list_transform(rest, lambda x: abs(x)))) AS peak FROM s)
SELECT layer, count(*) AS n_vectors, sum(bad) AS n_not_finite, max(peak) AS peak, count(*) FILTER (WHERE peak > 65504) AS n_beyond FROM p GROUP BY layer""")  # fmt: skip
def _(v):
    # vectors with a very large number, with NaN and with minus infinity among them
    at = F.col("idx") + F.col("layer")
    x = lambda i: F.element_at("vec", i).cast("double")
    first = F.array(x(1) * F.when(at % 11 == 0, 1e9).otherwise(1.0), F.when(at % 7 == 0, float("nan")).otherwise(x(2)), F.when(at % 13 == 0, float("-inf")).otherwise(x(3)))
    return probe.vector_quality(v.layers.withColumn("vec", F.concat(first, F.slice("vec", 4, 29).cast("array<double>"))))


@query("head_class_means", "flat_head:l y:l n:l mean_first:d mean_square_first:d", "heads", "SELECT flat_head, y, count(*) AS n, avg(vec[1]::DOUBLE) AS mean_first, avg(vec[1]::DOUBLE * vec[1]) AS mean_square_first FROM heads GROUP BY flat_head, y")
def _(v):
    s = probe.head_statistics(heads(v))
    return s.select("flat_head", "y", "n", (F.col("s")[0] / F.col("n")).alias("mean_first"), (F.col("ss")[0] / F.col("n")).alias("mean_square_first"))


def eliminated(m: str) -> str:
    """SQL of the list of rows `m` (a column), a matrix and right sides, after Gauss-Jordan elimination."""
    return f"""list_reduce(list_prepend({m}, list_transform(range(len({m})), lambda z: {m})), lambda a, x, i: list_transform(a, lambda r, ii:
      CASE WHEN ii = i - 1 THEN list_transform(r, lambda v: v / a[i - 1][i - 1]) ELSE list_transform(r, lambda v, j: v - r[i - 1] * a[i - 1][j] / a[i - 1][i - 1]) END))"""


DISCRIMINANTS = f"""e AS (SELECT flat_head, idx, y, i, vec[i]::DOUBLE AS v FROM heads, range(1, 9) t(i)),
mu AS (SELECT flat_head, y, i, avg(v) AS m, count(*) AS n FROM e GROUP BY ALL), o AS (SELECT flat_head, sum(n) AS n FROM mu WHERE i = 1 GROUP BY flat_head),
z AS (SELECT e.flat_head, e.idx, list(e.v - mu.m ORDER BY e.i) AS c FROM e JOIN mu ON mu.flat_head = e.flat_head AND mu.y = e.y AND mu.i = e.i GROUP BY e.flat_head, e.idx),
cv AS (SELECT z.flat_head, i, j, sum(c[i] * c[j]) / any_value(n - 2) + CASE WHEN i = j THEN 0.01 ELSE 0 END AS v FROM z JOIN o ON o.flat_head = z.flat_head, range(1, 9) a(i), range(1, 9) b(j) GROUP BY z.flat_head, i, j),
l AS (SELECT cv.flat_head, cv.i, list_append(list(cv.v ORDER BY cv.j), any_value(p.m - q.m)) AS l FROM cv JOIN mu p ON p.flat_head = cv.flat_head AND p.i = cv.i AND p.y = 1 JOIN mu q ON q.flat_head = cv.flat_head AND q.i = cv.i AND q.y = 0 GROUP BY cv.flat_head, cv.i),
m AS (SELECT flat_head, list(l ORDER BY i) AS m FROM l GROUP BY flat_head), w AS (SELECT flat_head, list_transform({eliminated("m")}, lambda r: r[9]) AS w FROM m)"""


@query("head_lda_auc", "flat_head:l auc:d", "heads", f"""
WITH {DISCRIMINANTS}, h AS (SELECT heads.flat_head, y, list_sum(list_transform(vec::DOUBLE[], lambda v, i: v * w[i])) AS s, 1 AS w FROM heads JOIN w ON w.flat_head = heads.flat_head), u AS ({weighted_auroc('s', 'h', 'flat_head')})
SELECT flat_head, greatest(auroc, 1 - auroc) AS auc FROM u""")  # fmt: skip
def _(v):
    return probe.head_lda_auc(heads(v))


@query("head_directions", "flat_head:l i:l w:d", "heads", f"WITH {DISCRIMINANTS} SELECT flat_head, unnest(range(1, 9)) AS i, unnest(w) AS w FROM w")
def _(v):
    return probe.head_directions(probe.head_statistics(heads(v))).select("flat_head", F.posexplode("w").alias("i", "w")).withColumn("i", F.col("i") + 1)


def simple_aucs(v):
    """An AUC of each head by its first number alone."""
    a = rank.auroc(heads(v).select("flat_head", "y", F.col("vec")[0].cast("double").alias("score")), ["flat_head"])
    return a.select("flat_head", F.greatest("auroc", 1 - F.col("auroc")).alias("auc"))


SIMPLE = f"h AS (SELECT flat_head, y, vec[1]::DOUBLE AS s, 1 AS w FROM heads), a AS ({weighted_auroc('s', 'h', 'flat_head')}), u AS (SELECT flat_head, greatest(auroc, 1 - auroc) AS auc FROM a)"


@query("head_auc_summary", "max_auc:d min_auc:d mean_auc:d p50:d p75:d p90:d p95:d p99:d cut_auc:d", "heads", f"""
WITH {SIMPLE} SELECT max(auc) AS max_auc, min(auc) AS min_auc, avg(auc) AS mean_auc, quantile_cont(auc, 0.5) AS p50, quantile_cont(auc, 0.75) AS p75, quantile_cont(auc, 0.9) AS p90, quantile_cont(auc, 0.95) AS p95, quantile_cont(auc, 0.99) AS p99,
  list_sort(list(auc), 'DESC')[3] AS cut_auc FROM u""")  # fmt: skip
def _(v):
    return probe.head_auc_summary(simple_aucs(v), 3)


@query("head_ranking", "rank:l flat_head:l auc:d layer:l head_in_layer:l", "heads", f"""
WITH {SIMPLE} SELECT *, flat_head // 4 AS layer, flat_head % 4 AS head_in_layer FROM (SELECT row_number() OVER (ORDER BY auc DESC, flat_head) AS rank, flat_head, auc FROM u) t WHERE rank <= 5""")  # fmt: skip
def _(v):
    return probe.head_ranking(simple_aucs(v), 5, 2, 8)


@query("select_head_features", "idx:l n:l first:d ninth:d last:d", "heads", f"""
WITH {SIMPLE}, r AS (SELECT row_number() OVER (ORDER BY auc DESC, flat_head) AS rank, flat_head FROM u), f AS (SELECT idx, flatten(list(vec ORDER BY rank)) AS f FROM heads JOIN r USING (flat_head) WHERE rank <= 3 GROUP BY idx)
SELECT idx, len(f) AS n, f[1] AS first, f[9] AS ninth, f[len(f)] AS last FROM f""")  # fmt: skip
def _(v):
    f = probe.select_head_features(heads(v), probe.head_ranking(simple_aucs(v), 3, 2, 8))
    return f.select("idx", F.size("features").alias("n"), F.col("features")[0].alias("first"), F.col("features")[8].alias("ninth"), F.element_at("features", -1).alias("last"))


@query("standardize", "idx:l score_a:d length:d", "items", """
WITH m AS (SELECT avg(score_a) AS ma, stddev_pop(score_a) AS sa, avg(length) AS ml, stddev_pop(length) AS sl FROM items WHERE split = 'train') SELECT idx, (score_a - ma) / sa AS score_a, (length - ml) / sl AS length FROM items, m""")  # fmt: skip
def _(v):
    return probe.standardize(v.items.filter("split = 'train'"), v.items, ("score_a", "length"))


@query("residualize", "idx:l rest:d", "items", """
WITH m AS (SELECT regr_slope(score_a, score_b) AS k, regr_intercept(score_a, score_b) AS c FROM items WHERE split = 'train') SELECT idx, score_a - c - k * score_b AS rest FROM items, m""")  # fmt: skip
def _(v):
    d = v.items.select("idx", "split", F.array("score_b").alias("shallow"), F.array("score_a").alias("features"))
    return probe.residualize(d.filter("split = 'train'"), d).select("idx", F.col("features")[0].alias("rest"))


@query("balance_train", "idx:l y:l n:l", "items", """
WITH t AS (SELECT * FROM items WHERE split = 'train'), s AS (SELECT y, count(*) AS n FROM t GROUP BY y), f AS (SELECT max(n) AS most, min(n) AS least, arg_min(y, n * 10 + y) AS small FROM s),
i AS (SELECT idx, y, row_number() OVER (ORDER BY md5(CAST(idx AS VARCHAR)), idx) - 1 AS i FROM t, f WHERE y = small), d AS (SELECT ('0x' || substr(md5('9:' || CAST(j AS VARCHAR)), 1, 8))::BIGINT % least AS i FROM (SELECT unnest(range(0, most)) AS j, least FROM f) z)
SELECT idx, y, count(*) AS n FROM (SELECT idx, y FROM t, f WHERE y <> small UNION ALL SELECT idx, y FROM i JOIN d USING (i)) x GROUP BY idx, y""")  # fmt: skip
def _(v):
    return probe.balance_train(v.items.filter("split = 'train'"), 9).groupBy("idx", "y").agg(F.count(F.lit(1)).alias("n"))


def features(v):
    """idx, y, features (the embedding), shallow (features of a text of the same id). Shallow features are found before rows meet, so that texts stay where they are."""
    e = v.embeddings.select(F.col("vec_id").alias("idx"), (F.col("label") < 5).cast("int").alias("y"), "embedding")
    out = e.join(probe.with_shallow(v.documents.select(F.col("doc_id").alias("idx"), "text"), "text").drop("text"), "idx")
    return out.select("idx", "y", F.col("embedding").cast("array<double>").alias("features"), "shallow")


def halves(d):
    return d.filter("idx % 5 < 3"), d.filter("idx % 5 >= 3")


FITTED = r"""n AS (SELECT doc_id AS idx, text, replace(regexp_extract_all(text, '(-?[0-9,]+\.?[0-9]*)', 1)[-1], ',', '') AS number, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t FROM documents),
f AS (SELECT n.idx, (label < 5)::INT AS y, n.idx % 5 < 3 AS train, embedding::DOUBLE[] AS x, [length(text), CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\s+')) END, length(text) - length(replace(text, chr(10), '')) + 1,
  length(text) - length(translate(text, '0123456789', '')), length(text) - length(translate(text, '+-*/=', '')), contains(text, '####')::INT, ln(1 + abs(coalesce(try_cast(number AS DOUBLE), 0)))]::DOUBLE[] AS shallow
  FROM n JOIN embeddings ON vec_id = n.idx)"""


def scaled(name: str, x: str, rows: str, to: str) -> str:
    """SQL of {name} (idx, y, train, x of `to`, standardised by the train rows of `rows`)."""
    return f"""{name}s AS MATERIALIZED (SELECT list(m ORDER BY i) AS mu, list(s ORDER BY i) AS sd FROM (SELECT i, avg({x}[i]) AS m, stddev_pop({x}[i]) AS s FROM (SELECT {x}, unnest(range(1, len({x}) + 1)) AS i FROM {rows} WHERE train) q GROUP BY i) q2),
{name} AS MATERIALIZED (SELECT {to}.* EXCLUDE ({x}), list_transform({x}, lambda v, i: (v - mu[i]) / CASE WHEN sd[i] > 0 THEN sd[i] ELSE 1 END) AS {x} FROM {to}, {name}s)"""


def newton_sql(name: str, x: str, rows: str, to: str, steps: int = 12, c: float = 0.5) -> str:
    """SQL of {name} (idx, y, train, score) of `to`: the regression on the train rows of `rows` by Newton steps from zero."""
    e = f"{name}e"
    out = [scaled(f"{name}z", x, rows, rows), scaled(f"{name}a", x, rows, to)]
    out.append(f"{e} AS MATERIALIZED (SELECT list_prepend(1.0::DOUBLE, {x}) AS x, y, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)) AS w FROM {name}z WHERE train)")
    out.append(f"{name}b0 AS MATERIALIZED (SELECT list_transform(any_value(x), lambda v: 0.0::DOUBLE) AS b FROM {e})")
    for k in range(steps):
        out.append(f"""{name}p{k} AS MATERIALIZED (SELECT x, w * (p - y) AS g, w * p * (1 - p) AS h FROM (SELECT x, y, w, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM {e}, {name}b{k}) q),
{name}h{k} AS (SELECT i, j, {c}::DOUBLE * sum(h * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END AS v FROM (SELECT x, h, i, unnest(range(1, len(x) + 1)) AS j FROM (SELECT x, h, unnest(range(1, len(x) + 1)) AS i FROM {name}p{k}) q1) q2 GROUP BY i, j),
{name}g{k} AS (SELECT i, {c}::DOUBLE * sum(g * x[i]) AS v FROM (SELECT x, g, unnest(range(1, len(x) + 1)) AS i FROM {name}p{k}) q1 GROUP BY i),
{name}m{k} AS MATERIALIZED (SELECT list(l ORDER BY i) AS m FROM (SELECT i, list_append(list(h.v ORDER BY j), any_value(g.v + CASE WHEN i > 1 THEN b[i] ELSE 0 END)) AS l FROM {name}h{k} h JOIN {name}g{k} g USING (i), {name}b{k} GROUP BY i) q),
{name}b{k + 1} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v - d[i]) AS b FROM {name}b{k}, (SELECT list_transform({eliminated("m")}, lambda r: r[-1]) AS d FROM {name}m{k}) q)""")
    out.append(f"{name} AS (SELECT idx, y, train, 1 / (1 + exp(-(b[1] + list_dot_product({x}, b[2:])))) AS score FROM {name}a, {name}b{steps})")
    return ",\n".join(out)


@query("fit_lr", "idx:l y:l score:d", "", f"WITH {FITTED}, {newton_sql('r', 'x', 'f', 'f')} SELECT idx, y, score FROM r WHERE NOT train")
def _(v):
    return probe.fit_lr(*halves(features(v)))


@query("shallow_probe", "idx:l y:l score:d", "", f"WITH {FITTED}, {newton_sql('r', 'shallow', 'f', 'f')} SELECT idx, y, score FROM r WHERE NOT train")
def _(v):
    return probe.shallow_probe(*halves(features(v).drop("features")))


@query("fit_mlp_ensemble", "idx:l y:l score:d")
def _(v):
    return probe.ensemble(probe.fit_mlp_ensemble(*halves(features(v))))


@query("seed_aucs", "member:l auroc:d mean_auroc:d sd_auroc:d")
def _(v):
    return probe.seed_aucs(probe.fit_mlp_ensemble(*halves(features(v))))


#: f with what its standardised shallow features explain taken off x: least squares on the train rows; a constant feature explains nothing.
CONTROLLED = f"""{scaled("cz", "shallow", "f", "f")}, ca AS MATERIALIZED (SELECT idx, train, list_prepend(1.0::DOUBLE, shallow) AS a, x FROM cz),
ch AS (SELECT i, j, sum(a[i] * a[j]) AS v FROM ca, range(1, 9) p(i), range(1, 9) q(j) WHERE train GROUP BY i, j), cg AS (SELECT i, j, sum(a[i] * x[j]) AS v FROM ca, range(1, 9) p(i), range(1, 65) q(j) WHERE train GROUP BY i, j),
cl AS (SELECT h.i, list_concat(h.l, g.l) AS l FROM (SELECT i, list(CASE WHEN i = j AND v = 0 THEN 1 ELSE v END ORDER BY j) AS l FROM ch GROUP BY i) h JOIN (SELECT i, list(v ORDER BY j) AS l FROM cg GROUP BY i) g USING (i)),
cm AS (SELECT list(l ORDER BY i) AS m FROM cl), cc AS MATERIALIZED (SELECT {eliminated("m")} AS coef FROM cm),
fc AS MATERIALIZED (SELECT f.idx, f.y, f.train, list_transform(f.x, lambda v, j: v - list_sum(list_transform(ca.a, lambda u, i: u * coef[i][8 + j]))) AS x FROM f JOIN ca USING (idx), cc)"""


@query("fit_raw_and_controlled", "idx:l detector:s y:l score:d", "", f"""
WITH {FITTED}, {CONTROLLED}, {newton_sql("r", "x", "f", "f")}, {newton_sql("k", "x", "fc", "fc")} SELECT idx, 'raw' AS detector, y, score FROM r WHERE NOT train UNION ALL SELECT idx, 'controlled', y, score FROM k WHERE NOT train""")  # fmt: skip
def _(v):
    return probe.fit_raw_and_controlled(*halves(features(v)))


@query("transfer_matrix", "source:s target:s auroc:d in_distribution:d retained:d", "", f"""
WITH {FITTED}, fe AS (SELECT * FROM f WHERE idx % 2 = 0), fo AS (SELECT * FROM f WHERE idx % 2 = 1), {newton_sql("e", "x", "fe", "f")}, {newton_sql("o", "x", "fo", "f")},
s AS (SELECT 'even' AS source, CASE WHEN idx % 2 = 0 THEN 'even' ELSE 'odd' END AS target, score AS s, y, 1 AS w FROM e WHERE NOT train UNION ALL SELECT 'odd', CASE WHEN idx % 2 = 0 THEN 'even' ELSE 'odd' END, score, y, 1 FROM o WHERE NOT train),
m AS ({weighted_auroc("s", "s", "source, target")}) SELECT m.source, m.target, m.auroc, q.auroc AS in_distribution, m.auroc - q.auroc AS retained FROM m JOIN m q ON q.source = q.target AND q.target = m.target""")  # fmt: skip
def _(v):
    d = features(v)
    return probe.transfer_deltas(probe.transfer_matrix({"even": halves(d.filter("idx % 2 = 0")), "odd": halves(d.filter("idx % 2 = 1"))}))


@query("transfer_deltas", "source:s target:s auroc:d in_distribution:d retained:d", "items", f"""
WITH s AS (SELECT 'a' AS source, run AS target, score_a AS s, y, 1 AS w FROM items UNION ALL SELECT run, run, score_b, y, 1 FROM items), m AS ({weighted_auroc("s", "s", "source, target")})
SELECT m.source, m.target, m.auroc, o.auroc AS in_distribution, m.auroc - o.auroc AS retained FROM m JOIN m o ON o.source = o.target AND o.target = m.target""")  # fmt: skip
def _(v):
    s = v.items.select(F.lit("a").alias("source"), F.col("run").alias("target"), F.col("score_a").alias("score"), "y")
    return probe.transfer_deltas(s.unionByName(v.items.select(F.col("run").alias("source"), F.col("run").alias("target"), F.col("score_b").alias("score"), "y")))


#: Every number of heads that the tables have, penalties, and hidden units (a number for each layer), besides the default's.
GRID = {"topk": (1, 2, 3, 5, 6, 7, 8), "c": (0.05, 0.1, 2.0, 10.0), "hidden": (32, 64, 256, 512, (128, 128))}


@query("sweep", "axis:s cell:s detector:s auroc:d")
def _(v):
    shallow = halves(features(v).select("idx", "shallow"))
    return probe.sweep(*halves(heads(v)), GRID, {"topk": 4, "c": 0.5, "hidden": 128}, ("lr_raw", "lr_controlled", "mlp_raw", "mlp_controlled"), shallow)


#: name of the CTE, axis, cell, heads, c
SWEPT = (("s0", "default", "default", 4, 0.5), ("s1", "topk", "1", 1, 0.5), ("s2", "topk", "2", 2, 0.5), ("s3", "topk", "8", 8, 0.5), ("s4", "c", "0.05", 4, 0.05), ("s5", "c", "0.1", 4, 0.1), ("s6", "c", "1.0", 4, 1.0), ("s7", "c", "2.0", 4, 2.0), ("s8", "c", "10.0", 4, 10.0))


def swept() -> str:
    chosen = ",\n".join(f"{n}f AS MATERIALIZED (SELECT idx, y, train, x[:{8 * k}] AS x FROM sf), {newton_sql(n, 'x', f'{n}f', f'{n}f', c=c)}" for n, _, _, k, c in SWEPT)
    every = " UNION ALL ".join(f"SELECT '{axis}' AS axis, '{cell}' AS cell, y, score AS s, 1 AS w FROM {n} WHERE NOT train" for n, axis, cell, _, _ in SWEPT)
    found = DISCRIMINANTS.replace("FROM heads, range(1, 9) t(i))", "FROM heads, range(1, 9) t(i) WHERE idx % 5 < 3)")
    return f"""WITH {found}, hs AS (SELECT heads.flat_head, y, list_sum(list_transform(vec::DOUBLE[], lambda v, i: v * w[i])) AS s, 1 AS w FROM heads JOIN w ON w.flat_head = heads.flat_head WHERE idx % 5 < 3),
hu AS ({weighted_auroc("s", "hs", "flat_head")}), hr AS (SELECT flat_head, row_number() OVER (ORDER BY greatest(auroc, 1 - auroc) DESC, flat_head) AS rank FROM hu),
sf AS MATERIALIZED (SELECT idx, any_value(y) AS y, idx % 5 < 3 AS train, flatten(list(vec::DOUBLE[] ORDER BY rank)) AS x FROM heads JOIN hr ON hr.flat_head = heads.flat_head GROUP BY idx),
{chosen}, every AS ({every}), a AS ({weighted_auroc("s", "every", "axis, cell")}) SELECT axis, cell, 'lr_raw' AS detector, auroc FROM a"""


@query("sweep_regressions", "axis:s cell:s detector:s auroc:d", "heads", swept())
def _(v):
    return probe.sweep(*halves(heads(v)), {"topk": (1, 2, 8), "c": (0.05, 0.1, 1.0, 2.0, 10.0)}, {"topk": 4, "c": 0.5})


@query("train_resample_auc", "n:l mean:d sd:d")
def _(v):
    return probe.spread(probe.train_resample_auc(*halves(heads(v)), 8, 5, 3, "lr_controlled", features(v).select("idx", "shallow")))
