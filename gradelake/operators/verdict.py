"""Probability mass that a judge's first token puts on YES and NO, under two rules of binning tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import classify_token
from gradelake.operators.rank import operating_point, rank_metrics, threshold_at_precision, wilson_interval

RULES = ("prefix", "exact")


def token_classes(vocab: DataFrame) -> DataFrame:
    """`vocab` (token_id, text) with the class of each token under both rules."""
    return vocab.withColumns({f"{r}_class": classify_token("text", r) for r in RULES})


def vocab_class_counts(vocab: DataFrame) -> DataFrame:
    """How many tokens each rule bins as yes and as no."""
    c = token_classes(vocab)
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_class").alias("class")) for r in RULES])
    return c.select(F.explode(pairs).alias("x")).filter("x.class is not null").groupBy(F.col("x.rule").alias("rule"), F.col("x.class").alias("class")).agg(F.count(F.lit(1)).alias("n_tokens"))


def p_yes(yes: Column, no: Column) -> Column:
    return F.coalesce(F.try_divide(yes, yes + no), F.lit(0.5))


def verdict_mass(tokens: DataFrame, rule: str = "prefix", window: int | None = 20, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """yes, no and other mass over the `window` most likely tokens (rank from 1; None: all), and p_yes, 0.5 without any.

    tokens: rank, prob and text. Classes are expressions over the text, so no join is needed.
    """
    t = tokens if window is None else tokens.filter(F.col("rank") <= window)
    t = t.withColumn("_class", F.coalesce(classify_token("text", rule), F.lit("other")))
    mass = lambda k: F.coalesce(F.sum(F.when(F.col("_class") == k, F.col("prob"))), F.lit(0.0)).alias(f"{k}_mass")
    out = t.groupBy(*by).agg(mass("yes"), mass("no"), mass("other"))
    return out.withColumn("p_yes", p_yes(F.col("yes_mass"), F.col("no_mass")))


def misbinned(tokens: DataFrame, side: str, window: int = 40) -> DataFrame:
    """Tokens that the prefix rule counts for `side` and the exact rule doesn't."""
    t = tokens.filter(F.col("rank") <= window)
    return t.filter((classify_token("text", "prefix") == side) & classify_token("text", "exact").isNull())


def misbinned_records(tokens: DataFrame, side: str, window: int = 40, noise: float = 1e-4, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """n_touched (records with more than `noise` of such mass), its mean and maximum over records, and the total."""
    per = misbinned(tokens, side, window).groupBy(*by).agg(F.sum("prob").alias("mass"))
    every = tokens.select(*by).distinct().join(per, list(by), "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    return every.agg(F.count_if(F.col("mass") > noise).alias("n_touched"), F.avg("mass").alias("mean_mass"), F.max("mass").alias("max_mass"), F.sum("mass").alias("total_mass"))


def misbinned_tokens(tokens: DataFrame, side: str, window: int = 40, top: int = 20) -> DataFrame:
    """The tokens with the most such mass: text, n, total_mass."""
    per = misbinned(tokens, side, window).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("total_mass"))
    return per.orderBy(F.desc(F.round("total_mass", 9)), "text").limit(top)


def compare_verdict_rules(tokens: DataFrame, items: DataFrame, windows: tuple[int | None, ...] = (20, 40, None), target: float = 0.5) -> DataFrame:
    """For each rule and window: auroc, ap, the train threshold for precision `target` and its recall and precision on test, how many p_yes are
    saturated or have no mass, and how many records move by more than 0.001 against the prefix rule in the first window.

    items: idx, split, y. The tokens are read once, for all rules and windows together.
    """
    named = [("full" if w is None else str(w), w) for w in windows]
    classes = {r: classify_token("text", r) for r in RULES}
    mass = lambda r, w, k: F.sum(F.when((classes[r] == k) & (F.lit(True) if w is None else F.col("rank") <= w), F.col("prob")).otherwise(0.0))
    sums = tokens.groupBy("idx").agg(*[mass(r, w, k).alias(f"{r}_{n}_{k}") for r in RULES for n, w in named for k in ("yes", "no")])
    each = [F.struct(F.lit(r).alias("rule"), F.lit(n).alias("window"), p_yes(F.col(f"{r}_{n}_yes"), F.col(f"{r}_{n}_no")).alias("p_yes")) for r in RULES for n, _ in named]
    cells = sums.select("idx", p_yes(F.col(f"{RULES[0]}_{named[0][0]}_yes"), F.col(f"{RULES[0]}_{named[0][0]}_no")).alias("_first"), F.explode(F.array(*each)).alias("c"))
    cells = cells.select("idx", "_first", "c.*")
    by = ["rule", "window"]
    d = cells.join(items.select("idx", "split", "y"), "idx").withColumn("error_score", 1 - F.col("p_yes"))
    test = d.filter(F.col("split") == "test")
    goal = d.select(*by).distinct().withColumn("target", F.lit(target))
    thr = threshold_at_precision(d.filter(F.col("split") == "train"), goal, by)
    counts = test.groupBy(*by).agg(
        F.count_if((F.col("p_yes") <= 0.02) | (F.col("p_yes") >= 0.98)).alias("n_saturated"),
        F.count_if(F.col("p_yes") == 0.5).alias("n_fallback"),
        F.count_if(F.abs(F.col("p_yes") - F.col("_first")) > 1e-3).alias("n_moved"),
        F.count_if(F.col("y") == 0).alias("_n_wrong"),
    )
    point = operating_point(test, thr, by).drop("n_flagged")
    out = rank_metrics(test, by, "p_yes").select(*by, "n", "auroc", "ap").join(counts, by).join(thr, by, "left").join(point, by, "left")
    low, high = wilson_interval(F.round(F.col("recall") * F.col("_n_wrong")), F.col("_n_wrong"))
    return out.withColumns({"recall_low": low, "recall_high": high}).drop("_n_wrong")
