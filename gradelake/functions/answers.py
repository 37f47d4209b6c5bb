"""Parsing answers out of texts, and their canonical forms. Built-in expressions wherever the grammar is regular."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gradelake.functions.latex import spelled
from gradelake.schemas import LATEX_DATASETS

_NUMBER = r"([-0-9,]+(?:\.[0-9]+)?)"
#: Where a final number stands, most telling first.
FINAL_NUMBER_PATTERNS = (
    r"####\s*" + _NUMBER,
    r"(?:the\s+)?(?:final\s+)?answer\s+is\s*:?\s*" + _NUMBER,
    r"(?:therefore|thus|so|hence)[,.]?\s+(?:the\s+)?(?:answer|result|total)\s+is\s*:?\s*" + _NUMBER,
    r"answer\s*:\s*" + _NUMBER,
    r"\*\*" + _NUMBER + r"\*\*",
    r"=\s*" + _NUMBER + r"\s*$",
)
#: LaTeX commands that box an answer.
BOXES = ("\\boxed", "\\fbox")
#: What a box without braces holds, what follows "answer is", and a number that goes by its value, with thousands separators or not.
BARE_BOX = r"\s*(-?[\d.]+|\\?[A-Za-z]+)"
ANSWER_LEADS = (r"(?:the\s+)?final\s+answer\s+is\s*:?\s*\$?", r"(?:the\s+)?answer\s+is\s*:?\s*\$?")
ANSWER_TAIL = r"((?:[^\n$.]|\.(?=\d))+)"
NUMERAL = r"[+-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
GOLD_MARKER = r"####\s*\$?\s*([+-]?[0-9,]+(?:\.[0-9]+)?)"

_PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
#: Significant digits that canonical numbers keep.
DIGITS = 28


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _if_number(c: Column) -> Column:
    return F.when(c.rlike(_PLAIN), c)


def parse_gold_marker(c: str | Column) -> Column:
    """The number after ####, without an optional $ and commas; null if there is none."""
    found = F.replace(F.regexp_extract(_col(c), GOLD_MARKER, 1), F.lit(","), F.lit(""))
    return _if_number(found)


def parse_final_number(c: str | Column) -> Column:
    """The first of FINAL_NUMBER_PATTERNS whose first match is a number, else the last standalone number; null if none."""
    c = _col(c)
    bare = lambda x: _if_number(F.replace(x, F.lit(","), F.lit("")))
    tries = [bare(F.regexp_extract(c, "(?im)" + p, 1)) for p in FINAL_NUMBER_PATTERNS]
    alone = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])" + _NUMBER + r"(?![\p{L}\p{N}_])"), F.lit(1))
    numbers = F.filter(F.transform(alone, bare), lambda x: x.isNotNull())
    return F.coalesce(*tries, F.try_element_at(numbers, F.lit(-1)))


def matching_brace(text: str, at: int) -> int:
    """The place of the brace that closes the one at `at`, or -1."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return -1


def last_box(text: str | None) -> str | None:
    """What the last box of `text` holds: up to its matching brace, or, without a brace, the next number or word."""
    best: tuple[int, str] | None = None
    inside = dict.fromkeys(BOXES, -1)  # a box within a box of the same command is part of what that one holds
    for m in re.finditer(r"\\(?:boxed|fbox)", text or ""):
        if m.start() <= inside[m[0]]:
            continue
        brace = re.compile(" *\\{").match(text, m.end())
        if brace:
            end = matching_brace(text, brace.end() - 1)
            if end >= 0:
                inside[m[0]] = end
                best = max(best or (-1, ""), (m.start(), text[brace.end() : end]))
        elif word := re.compile(BARE_BOX).match(text, m.end()):
            best = max(best or (-1, ""), (m.start(), word[1]))
    return best[1] if best else None


def exact_number(text: str | None) -> str | None:
    """The canonical form of anything that reads as a finite decimal number, else null."""
    if text is None:
        return None
    t = text.strip().replace(",", "")
    t = t[1:].strip() if t.startswith("$") else t
    try:
        d = Decimal(t)
    except (InvalidOperation, ValueError):
        return None
    return None if not d.is_finite() else "0" if d == 0 else format(d.normalize(), "f")


def one_latex(value: str | None) -> str | None:
    """The canonical form of a LaTeX answer, null if nothing is left of it: numerals by value, all else, lists with commas too, as spelled."""
    t = re.sub(r"^[A-Za-z]=(?=.)", "", spelled(value)).rstrip(".")
    if re.fullmatch(NUMERAL, t):
        return exact_number(t)
    return re.sub(r"^([+-]?)\.(?=\d)", r"\g<1>0.", t) or None


def one_math_answer(text: str | None) -> str | None:
    box = last_box(text)
    if box is not None and spelled(box).rstrip("."):
        return box
    for lead in ANSWER_LEADS:
        if (m := re.search(lead + ANSWER_TAIL, text or "", re.IGNORECASE)) and spelled(m[1]).rstrip("."):
            return m[1].strip()
    return None


def _batched(f):
    def run(s: pd.Series) -> pd.Series:
        # repeated answers are worked out once a batch
        codes, values = pd.factorize(s, use_na_sentinel=False)
        done = pd.Series([f(None if pd.isna(v) else v) for v in values], dtype=object)
        return done.take(codes).reset_index(drop=True)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(run, "string")


def extract_boxed(c: str | Column) -> Column:
    return _batched(last_box)(_col(c))


def parse_math_answer(c: str | Column) -> Column:
    """The last box, else what follows "(final) answer is", up to a full stop that is no decimal point."""
    return _batched(one_math_answer)(_col(c))


def canonical_number(c: str | Column, other_spellings: bool = False) -> Column:
    """One string for all spellings of a number: 64.00, $64 and +64 are 64. Null if it is none.

    Plain literals of up to DIGITS digits stay in the JVM. With other_spellings (exponents and whatever else a decimal may be spelled
    like, longer literals) those few go through an Arrow batch; without, they are null.
    """
    ready = _col(c).rlike(r"^(0|-?[1-9][0-9]{0,26})$")  # most answers: whole numbers as they should be
    t = F.replace(F.btrim(_col(c), F.lit(" \t\n\r\x0b\x0c")), F.lit(","), F.lit(""))
    t = F.when(t.startswith("$"), F.btrim(F.substring(t, 2, 1 << 30), F.lit(" \t\n\r\x0b\x0c"))).otherwise(t)
    plain = t.rlike(_PLAIN) & (F.length(F.regexp_replace(t, "[^0-9]", "")) <= DIGITS)
    whole = F.regexp_replace(F.regexp_extract(t, r"^[+-]?([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(t, r"\.([0-9]*)$", 1), "0+$", "")
    size = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    made = F.when(size == "0", "0").otherwise(F.concat(F.when(t.startswith("-"), "-").otherwise(""), size))
    out = F.when(ready, _col(c)).when(plain, made)
    return F.coalesce(out, _batched(exact_number)(F.when(~plain, _col(c)))) if other_spellings else out


def canonical_latex(c: str | Column) -> Column:
    return _batched(one_latex)(_col(c))


def canonical_answer(c: str | Column, dataset: str | Column, latex: bool = True, other_spellings: bool = True) -> Column:
    """The canonical form under the dataset's policy. latex=False leaves the LaTeX policy out where no row needs it."""
    number = canonical_number(c, other_spellings)
    if not latex:
        return number
    is_latex = F.coalesce(_col(dataset).isin(*LATEX_DATASETS), F.lit(False))
    return F.when(is_latex, canonical_latex(F.when(is_latex, _col(c)))).otherwise(number)


def answers_equal(a: str | Column, b: str | Column, dataset: str | Column, latex: bool = True) -> Column:
    """Whether both are the same answer under the dataset's policy. A missing answer equals nothing."""
    return F.coalesce(canonical_answer(a, dataset, latex) == canonical_answer(b, dataset, latex), F.lit(False))


def parse_verdict(c: str | Column) -> Column:
    """YES or NO: the leading word, else the last one standing alone, else NO. Null text is NO."""
    t = F.upper(F.btrim(_col(c), F.lit(" \t\n\r\x0b\x0c")))
    said = F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w.isin("YES", "NO"))
    return F.when(t.startswith("YES"), "YES").when(t.startswith("NO"), "NO").otherwise(F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit("NO")))
