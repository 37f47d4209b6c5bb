"""Parsers and canonical forms, case by case."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradelake.functions import answers as A
from gradelake.functions.prompts import render_prompts
from gradelake.functions.text import FEATURES, classify_token, shallow_features
from gradelake.operators import grade


def apply(spark, column, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", column("v").alias("x")).orderBy("i").collect()]


GOLD = {"so\n#### 12": "12", "#### -1,234.50": "-1234.50", "#### $ 7": "7", "12": None, "#### ,": None, None: None, "####+3": "+3"}
FINAL = {
    "a\n#### 41 and 7": "41", "The final answer is: 1,200.": "1200", "Hence the total is 9 apples": "9", "ANSWER: -4.5": "-4.5", "we get **17** so": "17",
    "a = 3\nb = 12 \nok": "3", "first 3, then 8 at last": "8", "call 5a or b6": None, "nothing": None, "answer is - but 6": "6", None: None, "": None,
}
BOXED = {
    r"\boxed{1} and \boxed{\frac{1}{2}}": r"\frac{1}{2}", r"\fbox{7}": "7", r"\boxed 5 ok": "5", r"\boxed{a \fbox{b}}": "b", r"\boxed{\boxed{3}}": r"\boxed{3}",
    r"\boxed{open": None, "none": None, None: None, r"\boxed{{x}}": "{x}", r"\boxed\pi": r"\pi",
}
MATH = {r"so \boxed{2}": "2", "The final answer is $0.5$.": "0.5", "the answer is: 12. Then more": "12", "I say 4": None, r"\boxed{} the answer is 3": "3", None: None}
LATEX = {
    "$2$": "2", r"\(x=5\)": "5", r"\dfrac12": r"\frac{1}{2}", r"\tfrac{3}{4}": r"\frac{3}{4}", r"12\text{ cm}": "12", r"\text{even}": "even", r"\text{ cm}": "cm", "1{,}000": "1000",
    "12,345.0": "12345", "1, 2": "1,2", ".50": "0.5", "-.5": "-0.5", r"90^\circ": "90", r"50\%": "50", r"\$3.20": "3.2", r"\left(1,2\right)": "(1,2)", r"\sqrt2": r"\sqrt{2}", "1e3": "1000",
    "y = -3": "-3", r"\\boxed{2": r"\\boxed{2", "}2{": "}2{", r"\frac{\sqrt3}2": r"\frac{\sqrt{3}}{2}", r"\frac{\frac12}{3}": r"\frac{\frac{1}{2}}{3}", r"\frac ab": r"\fracab", r"\[ \dfrac 3 4 \]": r"\frac34",
    r"5\text{ inches} or so": "5", r"\(12\text{ cm}\)": "12", r"\text{\(7\)}": "7", r"\leftarrow": r"\leftarrow", r"\text{}": None, "$$": None, r"30^{\circ}": "30", "(1,000)": "(1,000)", r"\text{not even}": "noteven", "x<5": "x<5",
    "7.": "7", "": None, None: None, r"\mathbf{\text{no}}": "no", "-0": "0", r"2\cdot3": r"2\cdot3",
}
NUMBER = {"64.00": "64", "$1,234": "1234", "-0": "0", "+5": "5", " 007.50 ": "7.5", "1e3": "1000", "x": None, "": None, None: None, "NaN": None, "Infinity": None, ".5": "0.5", "1 2": None, "$": None, "12.": "12", "-.50": "-0.5"}
VERDICT = {"Yes, fine": "YES", " no.": "NO", "No errors at all, so YES": "NO", "I found no errors; my verdict: yes": "YES", "unsure": "NO", "NOÉ says yes": "NO", "é yesé yes é": "YES", None: "NO", "": "NO"}


@pytest.mark.parametrize("f,cases", [(A.parse_gold_marker, GOLD), (A.parse_final_number, FINAL), (A.extract_boxed, BOXED), (A.parse_math_answer, MATH), (A.canonical_latex, LATEX), (A.parse_verdict, VERDICT), (lambda c: A.canonical_number(c, True), NUMBER)])
def test_cases(spark, f, cases):
    assert dict(zip(cases, apply(spark, f, list(cases)), strict=True)) == cases


def test_numbers_are_canonical_like_exact_decimals(spark):
    r = random.Random(1)
    values = [f"{r.choice(['', '-', '+'])}{r.choice(['', '0', '00'])}{r.randrange(10 ** r.choice([1, 5, 20]))}{r.choice(['', '.', '.0', '.50', '.' + str(r.randrange(10**6))])}" for _ in range(300)]
    want = ["0" if (d := Decimal(v)) == 0 else format(d.normalize(), "f") for v in values]
    assert apply(spark, A.canonical_number, values) == want
    long = ["1" * 40, "0." + "7" * 35]
    assert apply(spark, lambda c: A.canonical_number(c, True), long) == [format(Decimal(v).normalize(), "f") for v in long]


def test_equality_follows_the_dataset(spark):
    rows = [("math", "\\frac12", "\\frac{1}{2}", True), ("math", "\\frac12", "0.5", False), ("math", "1,2", "12", False), ("gsm8k", "1,2", "12", True), (None, "2.0", "$2", True), ("new", "x", "x", False), ("math", None, None, False), ("math", "x", "x", True)]
    df = spark.createDataFrame(rows, "dataset string, a string, b string, want boolean")
    assert df.filter(A.answers_equal("a", "b", "dataset") != F.col("want")).count() == 0


def test_grading_and_reasons(spark):
    rows = [
        (1, "gsm8k", "5", "5.0", "4", None, False, None), (2, "math", None, "5", "5", None, None, "no_gold"), (3, "gsm8k", "5", None, None, None, True, "truncated"),
        (4, "gsm8k", "x", "5", "5", "failed", True, "error"), (5, None, "7", "8", "7.00", None, None, None),
    ]
    df = spark.createDataFrame(rows, "idx long, dataset string, gold_answer string, phase1_answer string, majority_answer string, error string, truncated boolean, want string")
    got = {r.idx: r for r in grade.grade_records(df.withColumn("label", F.lit(True))).withColumn("reason", grade.exclusion_reason()).collect()}
    assert [got[i].reason for i in range(1, 6)] == [r[-1] for r in rows]
    assert [got[i].label for i in range(1, 6)] == [True, None, False, None, False]
    assert got[5].majority_correct and not got[1].majority_correct and got[2].label_policy != got[1].label_policy


def test_shallow_features(spark):
    text = "a + b = 12\n#### $-1,500.5"
    df = spark.createDataFrame([(text,), (None,), ("no number",), ("9" * 400,)], "t string")
    rows = [[r[f] for f in FEATURES] for r in df.select([c.alias(n) for n, c in shallow_features("t").items()]).collect()]
    import math

    assert rows[0] == pytest.approx([len(text), 7, 2, 7, 3, 1, math.log1p(1500.5)]) and rows[1] == [0, 0, 1, 0, 0, 0, 0] and rows[2][-1] == 0 and rows[3][-1] == 0


def test_token_classes(spark):
    cases = {"Yes": ("yes", "yes"), ' "NO:"*': ("no", "no"), "NOTE": ("no", None), "Yesterday": ("yes", None), "y": ("yes", "yes"), "ye": ("yes", "yes"), "n": ("no", "no"), "maybe": (None, None), "": (None, None), None: (None, None)}
    for k, rule in enumerate(("prefix", "exact")):
        assert apply(spark, lambda c, rule=rule: classify_token(c, rule), list(cases)) == [v[k] for v in cases.values()]
    with pytest.raises(ValueError):
        classify_token("v", "other")


def test_prompts_hold_problem_and_solution(spark):
    df = spark.createDataFrame([("math", "P {solution}", "S"), ("other", None, "S2")], "dataset string, problem string, phase1_solution string")
    for kind in ("solve", "judge", "error_hunt", "error_hunt_soft", "step_grade"):
        a, b = (r.prompt for r in render_prompts(df, kind).collect())
        assert "P {solution}" in a and (kind == "solve") == ("S2" not in b)
