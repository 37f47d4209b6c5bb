"""Prompt texts for batch inference, by dataset and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SOLVE = "Work through this problem one step at a time.\n\n{problem}\n\n"
_JUDGE = "Problem:\n{problem}\n\nProposed solution:\n{solution}\n\n"
_ANSWER = {"gsm8k": "the number after ####", "math": "the expression in the last \\boxed{}"}
_EQUAL = {"gsm8k": "Numbers are equal whatever their separators and trailing zeros.", "math": "Expressions are equal if they are the same value in another spelling; a fraction and its decimal are not."}
KINDS = ("solve", "judge", "error_hunt", "error_hunt_soft", "step_grade")
TEMPLATES = {
    ("gsm8k", "solve"): _SOLVE + "Finish with a line of the form #### number.",
    ("math", "solve"): _SOLVE + "Put the final answer in \\boxed{}.",
    **{(d, "judge"): _JUDGE + f"Is {a} the right final answer? {_EQUAL[d]} Begin your reply with YES or NO." for d, a in _ANSWER.items()},
    **{(d, "error_hunt"): _JUDGE + f"Look for a mistake in any step that leads to {a}. Answer NO if you find one, else YES." for d, a in _ANSWER.items()},
    **{(d, "error_hunt_soft"): _JUDGE + f"Look for a mistake that changes {a}. Slips without consequence don't count. Answer NO only if you find one, else YES." for d, a in _ANSWER.items()},
    **{(d, "step_grade"): _JUDGE + f"Grade every step as right or wrong, then say YES if {a} is right, else NO. {_EQUAL[d]}" for d, a in _ANSWER.items()},
}


def template(dataset: str, kind: str) -> str:
    """The text of a kind for a dataset; unknown datasets have that of gsm8k."""
    return TEMPLATES.get((dataset, kind)) or TEMPLATES["gsm8k", kind]


def filled(text: str, problem: Column, solution: Column) -> Column:
    out, at = [], 0
    for mark, c in sorted((text.find(m), x) for m, x in (("{problem}", 0), ("{solution}", 1)) if m in text):
        out += [F.lit(text[at:mark]), F.coalesce(solution if c else problem, F.lit(""))]
        at = mark + len("{solution}" if c else "{problem}")
    return F.concat(*out, F.lit(text[at:]))


def render_prompts(df: DataFrame, kind: str, datasets: tuple[str, ...] = ("math",)) -> DataFrame:
    """`df` with prompt: the template of the row's dataset (unknown ones: gsm8k's) filled with problem and phase1_solution."""
    out = F.when(F.lit(False), F.lit(""))
    for d in datasets:
        out = out.when(F.col("dataset") == d, filled(template(d, kind), F.col("problem"), F.col("phase1_solution")))
    return df.withColumn("prompt", out.otherwise(filled(template("gsm8k", kind), F.col("problem"), F.col("phase1_solution"))))


def render_every_kind(df: DataFrame, datasets: tuple[str, ...] = ("math",)) -> DataFrame:
    """`df` (with kind) with prompt, each row's by its own kind; an unknown kind has none."""
    out = F.lit(None).cast("string")
    for kind in KINDS:
        for d in (None, *datasets):
            own = F.col("kind") == kind if d is None else (F.col("kind") == kind) & (F.col("dataset") == d)
            out = F.when(own, filled(template(d or "gsm8k", kind), F.col("problem"), F.col("phase1_solution"))).otherwise(out)
    return df.withColumn("prompt", out)
