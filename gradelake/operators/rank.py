"""Tie-exact rank metrics. y is 1 for a right answer; a high score says right, so the lowest scores are reviewed first.

Everything starts from tie groups: one row for each distinct score of a group, with its counts. That shrinks saturated scores to a few rows before
anything is ordered. Tie groups are moved once more, by group and part, and ordered there. A group of up to PART_CELLS tie groups is one part; a larger one is
cut at quantiles of its scores into as many parts as it needs, and the parts' totals give offsets. Ties share a part, so results are exact. What the large groups
add to the cells (cuts, totals, offsets) is broadcast: a few numbers for each PART_CELLS cells of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGETS = (0.02, 0.05, 0.075, 0.10, 0.125, 0.15, 0.20)
COVERAGES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
#: Tie groups that one task orders, about.
PART_CELLS = 1 << 20
#: Quantiles a large group is cut at, at most, so many of them beside a row at once; and how finely they are estimated.
CUTS, CUTS_AT_ONCE, ACCURACY = 4096, 64, 20_000
Z95 = 1.959963984540054
_GAMMA = 0.5772156649015329


def tie_groups(df: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """One row for each score of a group: n, pos and wrong (sums of `weight` if given). Null scores and labels are left out."""
    w = F.col(weight) if weight else F.lit(1)
    usable = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    g = usable.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(y).cast("int")).alias("pos"))
    return g.filter("n > 0").withColumn("wrong", F.col("n") - F.col("pos"))


def beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """`left` with the other columns of `right`, which is small and has one row for each value of `by` (nulls included; one row in all if `by` is empty)."""
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or F.lit(True)
    return left.alias("l").join(F.broadcast(right.alias("r")), same, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in by])


def part_of(score: Column, cuts: Column, most: int = CUTS) -> Column:
    """How many of the ascending `cuts`, fewer than `most` (a power of two), lie below the score: a binary search."""
    steps = F.array(*[F.lit(most >> i) for i in range(1, most.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < score, at + step).otherwise(at))


def cut_runs(cuts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """`cuts` with every CUTS_AT_ONCE-th of their _cuts alone; and by, _run and the _cuts in between, a row for each run of them."""
    coarse = cuts.withColumn("_cuts", F.filter("_cuts", lambda x, i: (i + 1) % CUTS_AT_ONCE == 0))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_cuts") / CUTS_AT_ONCE).cast("int")), lambda i: F.slice("_cuts", i * CUTS_AT_ONCE + 1, F.lit(CUTS_AT_ONCE - 1)))
    return coarse, cuts.select(*by, F.posexplode(runs).alias("_run", "_cuts"))


def with_part(cells: DataFrame, cuts: DataFrame, by: list[str], order: str) -> DataFrame:
    """`cells` with _part, how many of their group's _cuts (ascending) lie below them, null without cuts, and the other columns of `cuts`.

    A row meets one short list at a time, however many cuts its group has.
    """
    coarse, fine = cut_runs(cuts, by)
    at = beside(cells, coarse, by, "left")
    at = at.withColumn("_run", F.when(F.col("_cuts").isNotNull(), part_of(F.col(order), F.col("_cuts"), CUTS_AT_ONCE))).drop("_cuts")
    found = beside(at, fine, [*by, "_run"], "left")
    inner = F.when(F.col("_run").isNotNull(), part_of(F.col(order), F.col("_cuts"), CUTS_AT_ONCE))
    return found.withColumn("_part", F.col("_run") * CUTS_AT_ONCE + inner).drop("_run", "_cuts")


def with_running(cells: DataFrame, by: list[str], descending: bool = False, values: tuple[str, ...] = ("n", "pos", "wrong"), part_cells: int | None = None, order: str = "score") -> DataFrame:
    """`cells` with {v}_before (sums over the cells before, in order of score) and {v}_all of each value. part_cells: cells of a part, PART_CELLS if not given.

    Every reading of the cells uses the same columns of them, so that all share one shuffle. No exchange is by the group alone.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    by, per = list(by), part_cells or PART_CELLS
    sums = [F.sum(v).alias(f"_{v}_all") for v in values]
    counts = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_cells"), *sums)
    large = counts.filter(F.col("_cells") > per).select(*by, "_cells")  # at most one row for each `per` cells
    shares = F.split(F.lit(" ".join(str(i / CUTS) for i in range(1, CUTS))), " ").cast("array<double>")  # one literal keeps the plan small
    quantiles = F.percentile_approx(order, shares, ACCURACY)
    found = beside(cells, large, by).groupBy(*by).agg(quantiles.alias("_q"), F.max("_cells").alias("_cells"), *sums)
    parts = F.least(F.lit(CUTS), F.ceil(F.col("_cells") / per)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_q", F.floor(i * CUTS / parts).cast("int") - 1))
    cuts = found.select(*by, F.array_distinct(chosen).alias("_cuts"), *[f"_{v}_all" for v in values])
    dealt = with_part(cells, cuts, by, order)
    totals = dealt.filter("_part is not null").groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(F.col("_part").desc() if descending else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.sum(f"_{v}").over(before).alias(f"_{v}_offset") for v in values])  # at most CUTS rows a large group
    own = Window.partitionBy(*by, "_part")
    inner = own.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda v: F.col(v) - F.col(v)  # noqa: E731  in the type of the value
    out = beside(dealt, offsets, [*by, "_part"], "left")
    out = out.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inner), zero(v)) + F.coalesce(f"_{v}_offset", zero(v)) for v in values} | {f"{v}_all": F.coalesce(f"_{v}_all", F.sum(v).over(own)) for v in values})
    return out.drop("_part", *[f"_{v}_{x}" for v in values for x in ("offset", "all")])


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 128, beyond by its expansion, which is exact to the last digits there."""
    x = n.cast("double")
    summed = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(128)).cast("int")), F.lit(0.0), lambda a, i: F.when(i > 0, a + 1 / i).otherwise(a))
    return F.when(n <= 128, summed).otherwise(F.log(x) + _GAMMA + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def auroc(df: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: str | None = None, part_cells: int | None = None) -> DataFrame:
    """auroc: the probability that a right answer scores above a wrong one, ties counting half; null with a single class."""
    cells = with_running(tie_groups(df, by, score, y, weight), by, values=("pos", "wrong"), part_cells=part_cells)
    pairs = F.sum(F.col("pos") * (F.col("wrong_before") + F.col("wrong") / 2))
    return cells.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("wrong").alias("n_wrong"), pairs.alias("_p")).select(*by, F.try_divide(F.col("_p"), F.col("n_pos").cast("double") * F.col("n_wrong")).alias("auroc"))


def rank_metrics(df: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: str | None = None, part_cells: int | None = None) -> DataFrame:
    """n, n_wrong, auroc, ap (average precision of wrong answers, tied blocks at once) and aurc (mean risk over all coverages, ties in expectation)."""
    c = with_running(tie_groups(df, by, score, y, weight), by, part_cells=part_cells)
    seen, hit = F.col("n_before") + F.col("n"), F.col("wrong_before") + F.col("wrong")
    above_n = F.col("n_all") - seen
    above_wrong = F.col("wrong_all") - hit
    share = F.col("wrong") / F.col("n")
    risk = F.col("n") * share + (above_wrong - above_n * share) * (harmonic(above_n + F.col("n")) - harmonic(above_n))
    agg = c.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("wrong").alias("n_wrong"),
        F.try_divide(F.sum(F.col("pos") * (F.col("wrong_before") + F.col("wrong") / 2)), F.sum("pos").cast("double") * F.sum("wrong")).alias("auroc"),
        F.try_divide(F.sum(F.col("wrong") * hit / seen), F.sum("wrong")).alias("ap"),
        (F.sum(risk) / F.sum("n")).alias("aurc"),
    )
    return agg


def average_precision(df: DataFrame, by: list[str], **how) -> DataFrame:
    return rank_metrics(df, by, **how).select(*by, "ap")


def balanced_accuracy(df: DataFrame, by: list[str], y: str = "y", pred: str = "verdict_yes") -> DataFrame:
    """The mean of both recalls of a binary verdict: its AUROC; null with a single class."""
    right, wrong = F.col(y) == 1, F.col(y) == 0
    yes = F.try_divide(F.count_if(right & (F.col(pred) == 1)), F.count_if(right))
    no = F.try_divide(F.count_if(wrong & (F.col(pred) == 0)), F.count_if(wrong))
    return df.groupBy(*by).agg(((yes + no) / 2).alias("balanced_accuracy"))


def pr_curve(df: DataFrame, by: list[str], score: str = "error_score", y: str = "y") -> DataFrame:
    """threshold, precision, recall of flagging error_score >= threshold, at each distinct threshold; the positive class is the wrong answers."""
    c = with_running(tie_groups(df, by, score, y), by, descending=True)
    flagged, hit = F.col("n_before") + F.col("n"), F.col("wrong_before") + F.col("wrong")
    return c.select(*by, F.col("score").alias("threshold"), (hit / flagged).alias("precision"), F.try_divide(hit, F.col("wrong_all")).alias("recall"))


def threshold_at_precision(train: DataFrame, target: DataFrame, by: list[str], score: str = "error_score", y: str = "y") -> DataFrame:
    """The lowest threshold of train whose precision reaches target.target (a row a group); null if none does."""
    curve = pr_curve(train, by, score, y).join(target, by)
    return curve.groupBy(*by).agg(F.min(F.when(F.col("precision") >= F.col("target"), F.col("threshold"))).alias("threshold"))


def oracle_recall(test: DataFrame, target: DataFrame, by: list[str], score: str = "error_score", y: str = "y") -> DataFrame:
    """The best recall over all thresholds of test whose precision reaches the target: descriptive, chosen on test itself."""
    curve = pr_curve(test, by, score, y).join(target, by)
    return curve.groupBy(*by).agg(F.max(F.when(F.col("precision") >= F.col("target"), F.col("recall"))).alias("oracle_recall"))


def operating_point(test: DataFrame, thresholds: DataFrame, by: list[str], score: str = "error_score", y: str = "y") -> DataFrame:
    """n_flagged, recall and precision of a frozen threshold on test; without one (null) nothing is known."""
    t = test.join(thresholds, by)
    flag, wrong = F.col(score) >= F.col("threshold"), F.col(y) == 0
    known = F.max("threshold").isNotNull()
    return t.groupBy(*by).agg(
        F.when(known, F.count_if(flag)).alias("n_flagged"),
        F.when(known, F.try_divide(F.count_if(flag & wrong), F.count_if(wrong))).alias("recall"),
        F.when(known, F.try_divide(F.count_if(flag & wrong), F.count_if(flag))).alias("precision"),
    )


def verdict_point(test: DataFrame, by: list[str], y: str = "y", pred: str = "verdict_yes") -> DataFrame:
    """The same of the judge's verdict, which flags what it doesn't say YES to; and how often it says YES and errs."""
    flag, wrong = F.col(pred) == 0, F.col(y) == 0
    n = F.count(F.lit(1))
    return test.groupBy(*by).agg(
        F.try_divide(F.count_if(flag & wrong), F.count_if(wrong)).alias("recall"),
        F.try_divide(F.count_if(flag & wrong), F.count_if(flag)).alias("precision"),
        (F.count_if(~flag) / n).alias("says_yes_rate"),
        (F.count_if(flag != wrong) / n).alias("error_rate"),
    )


def error_detection(train: DataFrame, test: DataFrame, by: list[str], score: str = "error_score", y: str = "y", pred: str = "verdict_yes") -> DataFrame:
    """A row a group, the report of error detection at the judge's own precision: the target and the threshold found on train; on test the detector's
    recall and precision at that frozen threshold with the interval of its recall, the best recall that any threshold of test would have had, and the judge's
    recall with its interval, precision, and the difference of both recalls. Without a threshold the detector's columns are null."""
    goal = verdict_point(train, by, y, pred).select(*by, F.col("precision").alias("target"))
    frozen = threshold_at_precision(train, goal, by, score, y)
    point = operating_point(test, frozen, by, score, y).select(*by, "n_flagged", "recall", "precision")
    judge = verdict_point(test, by, y, pred).select(*by, F.col("recall").alias("judge_recall"), F.col("precision").alias("judge_precision"))
    wrong = test.groupBy(*by).agg(F.count_if(F.col(y) == 0).alias("n_wrong"), F.count(F.lit(1)).alias("n"))
    out = wrong.join(goal, by, "left").join(frozen, by, "left").join(point, by, "left").join(oracle_recall(test, goal, by, score, y), by, "left").join(judge, by, "left")
    ends = {}
    for name in ("recall", "judge_recall"):
        ends[f"{name}_low"], ends[f"{name}_high"] = wilson_interval(F.round(F.col(name) * F.col("n_wrong")), F.when(F.col(name).isNotNull(), F.col("n_wrong")))
    return out.withColumns(ends | {"recall_difference": F.col("recall") - F.col("judge_recall")})


def wilson_interval(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """(low, high) of k of n, within 0 to 1 and around k / n; null for n = 0 and for an unknown k."""
    n, p = n.cast("double"), F.try_divide(k.cast("double"), n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), F.least(mid - half, p)), F.least(F.lit(1.0), F.greatest(mid + half, p))
    known = (n > 0) & k.isNotNull()  # greatest and least pass over nulls
    return F.when(known, low), F.when(known, high)


def at_ranks(cells: DataFrame, by: list[str], ranks: Column, name: str, column: str) -> DataFrame:
    """Cells (with running sums in review order) that one of `ranks` (array of struct(label, m)) falls into, a row for each that does; rank 0 is in the first cell.

    Every cell looks for its ranks; only those that hold one go on, so the cells are not multiplied.
    """
    first = F.col("n_before") == 0
    own = F.filter(ranks, lambda r: ((F.col("n_before") < r["m"]) | (first & (r["m"] == 0))) & (r["m"] <= F.col("n_before") + F.col("n")))
    out = cells.withColumn("_own", own).filter(F.size("_own") > 0)
    return out.withColumn("_r", F.explode("_own")).withColumns({column: F.col("_r.label"), name: F.col("_r.m")}).drop("_r", "_own")


def budget_rank(n: Column, share: Column) -> Column:
    """How many are reviewed: the share rounded half up, at least 1 and at most all but one."""
    return F.greatest(F.lit(1), F.least(n - 1, F.floor(share * n + 0.5))).cast("long")


def budget_metrics(df: DataFrame, by: list[str], score: str = "score", y: str = "y", budgets: tuple[float, ...] = BUDGETS, part_cells: int | None = None, weight: str | None = None) -> DataFrame:
    """For each budget: reviewed (the lowest m), recall of wrong answers, and residual_risk among the rest; ties in expectation."""
    cells = with_running(tie_groups(df, by, score, y, weight), by, part_cells=part_cells)
    ranks = F.transform(F.array(*map(F.lit, budgets)), lambda b: F.struct(b.alias("label"), budget_rank(F.col("n_all"), b).alias("m")))
    c = at_ranks(cells, by, ranks, "reviewed", "budget")
    caught = F.col("wrong_before") + (F.col("reviewed") - F.col("n_before")) * F.col("wrong") / F.col("n")
    return c.select(*by, "budget", "reviewed", F.try_divide(caught, F.col("wrong_all")).alias("recall"), F.try_divide(F.col("wrong_all") - caught, F.col("n_all") - F.col("reviewed")).alias("residual_risk"))


def risk_coverage(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """coverage and risk after accepting each tie group, best first; within a group risk is linear in what is accepted."""
    c = with_running(tie_groups(df, by, score, y), by, descending=True)
    accepted, wrong = F.col("n_before") + F.col("n"), F.col("wrong_before") + F.col("wrong")
    return c.select(*by, "score", (accepted / F.col("n_all")).alias("coverage"), (wrong / accepted).alias("risk"))


def aurc(df: DataFrame, by: list[str], **how) -> DataFrame:
    return rank_metrics(df, by, **how).select(*by, "aurc")


def selective_error(df: DataFrame, by: list[str], score: str = "score", y: str = "y", coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """The risk of the best int(coverage * n) answers, ties in expectation."""
    cells = with_running(tie_groups(df, by, score, y), by, descending=True)
    ranks = F.transform(F.array(*map(F.lit, coverages)), lambda c: F.struct(c.alias("label"), F.greatest(F.lit(1), F.floor(c * F.col("n_all"))).alias("m")))
    c = at_ranks(cells, by, ranks, "accepted", "coverage")
    wrong = F.col("wrong_before") + (F.col("accepted") - F.col("n_before")) * F.col("wrong") / F.col("n")
    return c.select(*by, "coverage", "accepted", (wrong / F.col("accepted")).alias("risk"))


def flag_at_budget(df: DataFrame, by: list[str], score: str = "score", seed: int = 0, share: float | None = None, like: Column | None = None) -> DataFrame:
    """`df` with flagged: whether a row is among the m lowest of its group, ties in a seeded order; null scores are not.

    m is the share of the group rounded half to even, or the number of its rows for which `like` holds (another detector's own flags).
    No group is ordered as a whole: the tie group that m falls into is found by prefix sums, in it the range of order hashes, and
    only the rows of that range are numbered. Every row then compares itself with its group's boundary.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string")))
    place = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")  # 4096 ranges
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    usable = df.filter(F.col(score).isNotNull())
    m = F.bround(F.lit(share) * F.count(F.lit(1))) if like is None else F.count_if(like)
    goals = df.groupBy(*by).agg(m.cast("long").alias("_m"))
    cells = with_running(usable.groupBy(*by, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n")), by, values=("n",))

    def within(cells: DataFrame, goals: DataFrame, key: str) -> DataFrame:
        """by, key and _m (what is left of it) of the cell that _m falls into."""
        on = same("c", "g")
        j = cells.alias("c").join(goals.alias("g"), on) if on else cells.alias("c").join(F.broadcast(goals.alias("g")))
        j = j.filter((F.col("n_before") < F.col("_m")) & (F.col("_m") <= F.col("n_before") + F.col("n")))
        return j.select(*[F.col(f"c.{c}").alias(c) for c in by], *[F.col(f"g.{c}") for c in goals.columns if c not in (*by, "_m")], F.col(key), (F.col("_m") - F.col("n_before")).alias("_m"))

    cut = within(cells, goals, "score").withColumnRenamed("score", "_cut")
    rows = usable.select(*by, F.col(score).alias("_s"), order.alias("_order"), F.col("idx").alias("_idx"), place.alias("_place"))
    ties = rows.alias("r").join(cut.alias("k"), [*same("r", "k"), F.col("_s") == F.col("_cut")]).select("r.*")
    ranges = with_running(ties.groupBy(*by, "_place").agg(F.count(F.lit(1)).alias("n")), by, values=("n",), order="_place")
    last = within(ranges, cut, "_place")
    near = ties.alias("r").join(last.alias("k"), [*same("r", "k"), F.col("r._place") == F.col("k._place")]).select("r.*", "k._m")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_order", "_idx"))
    edge = near.withColumn("_nth", nth).filter("_nth = _m").select(*by, F.struct(F.col("_s").alias("s"), F.col("_order").alias("o"), F.col("_idx").alias("i")).alias("_edge"))
    own = F.struct(F.col(score).alias("s"), order.alias("o"), F.col("idx").alias("i"))
    out = df.alias("d").join(edge.alias("e"), same("d", "e") or F.lit(True), "left")
    return out.select("d.*", F.coalesce(F.col(score).isNotNull() & (own <= F.col("_edge")), F.lit(False)).alias("flagged"))


def flagged_metrics(flagged: DataFrame, by: list[str], y: str = "y", z: float = 1.96) -> DataFrame:
    """n_flagged, tp, recall, precision and the interval of recall of a flagged set."""
    tp, wrong = F.count_if(F.col("flagged") & (F.col(y) == 0)), F.count_if(F.col(y) == 0)
    out = flagged.groupBy(*by).agg(F.count_if("flagged").alias("n_flagged"), tp.alias("tp"), wrong.alias("n_wrong"))
    low, high = wilson_interval(F.col("tp"), F.col("n_wrong"), z)
    return out.select(*by, "n_flagged", "tp", F.try_divide("tp", "n_wrong").alias("recall"), F.try_divide("tp", "n_flagged").alias("precision"), low.alias("low"), high.alias("high"))


def level_breakdown(df: DataFrame, by: list[str] = ("run", "level"), detectors: tuple[str, ...] = ("probe", "judge")) -> DataFrame:
    """n, n_wrong and prevalence of each level, the AUROC of each detector, and how far the first is above the second. df: long, by detector."""
    m = rank_metrics(df, [*by, "detector"])
    wide = m.groupBy(*by).pivot("detector", list(detectors)).agg(F.first("auroc"))
    size = m.groupBy(*by).agg(F.max("n").alias("n"), F.max("n_wrong").alias("n_wrong"))
    a, b = (F.col(d) for d in detectors)
    return size.join(wide, list(by)).select(*by, "n", "n_wrong", (F.col("n_wrong") / F.col("n")).alias("prevalence"), a.alias(f"auroc_{detectors[0]}"), b.alias(f"auroc_{detectors[1]}"), (a - b).alias("difference"))


def budget_calibration(lengths: DataFrame, truncated_share: float, shares: tuple[float, ...] = (0.95, 0.99, 0.999, 1.0), length: str = "length") -> DataFrame:
    """For each share q of all records: the length (raw) that covers it, and the next power of two (rounded).

    Only the records that had been cut off were measured again. Null where the old budget covers q already.
    """
    counts = lengths.groupBy(F.col(length).cast("long").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("pos"))
    cells = with_running(counts, [], values=("n",))
    want = F.array(*[F.struct(F.lit(q).alias("q"), F.lit((q - (1 - truncated_share)) / truncated_share).alias("within"), F.lit(q > 1 - truncated_share).alias("new")) for q in shares])
    place = lambda w: F.least(F.bround(w["within"] * (F.col("n_all") - 1)), F.col("n_all") - 1)
    own = F.filter(want, lambda w: (F.col("n_before") <= place(w)) & (place(w) < F.col("n_before") + F.col("n")) & w["new"])
    hit = cells.withColumn("own", own).filter(F.size("own") > 0).withColumn("w", F.explode("own"))
    all_q = lengths.sparkSession.createDataFrame([(float(q),) for q in shares], "q double")
    hit = hit.select(F.col("w.q").alias("q"), F.col("score").alias("raw"))
    return all_q.join(F.broadcast(hit), "q", "left").select("q", "raw", F.pow(F.lit(2.0), F.ceil(F.log2("raw"))).cast("long").alias("rounded"))


def length_summary(lengths: DataFrame, length: str = "length", by: tuple[str, ...] = ()) -> DataFrame:
    """n, median, p90, p99 and max of the lengths measured again: the values at ranks n // 2, int(.9 n), int(.99 n) from 0."""
    counts = lengths.groupBy(*by, F.col(length).cast("long").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    c = with_running(counts, list(by), values=("n",))
    at = lambda share: F.max(F.when((F.col("n_before") <= share) & (share < F.col("n_before") + F.col("n")), F.col("score")))
    n = F.col("n_all")
    return c.groupBy(*by).agg(F.sum("n").alias("n"), at(F.floor(n / 2)).alias("median"), at(F.floor(n * 0.9)).alias("p90"), at(F.floor(n * 0.99)).alias("p99"), F.max("score").alias("max"))
