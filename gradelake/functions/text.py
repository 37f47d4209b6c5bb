"""Shallow features of a solution's text, and classes of verdict tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = ("n_chars_f", "n_words_f", "n_lines_f", "n_digits_f", "n_operators_f", "has_marker_f", "log_number_f")


def shallow_features(c: str) -> dict[str, Column]:
    """The seven features of column `c` by name; null counts as empty. The last is log1p of the last number's size, marked numbers first."""
    t = F.coalesce(F.col(c), F.lit(""))
    trimmed = F.btrim(t, F.lit(" \t\n\r\x0b\x0c"))
    last = lambda p: F.try_element_at(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.lit(-1))
    number = F.coalesce(last(r"####\s*\$?(-?[0-9,]+\.?[0-9]*)"), last(r"(-?[0-9,]+\.?[0-9]*)"))
    value = F.coalesce(F.replace(number, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    exprs = (
        F.length(t),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))),
        F.length(t) - F.length(F.translate(t, "\n", "")) + 1,
        F.length(t) - F.length(F.translate(t, "0123456789", "")),
        F.length(t) - F.length(F.translate(t, "+-*/=", "")),
        F.contains(t, F.lit("####")).cast("int"),
        F.log1p(F.when(F.abs(value) < float("inf"), F.abs(value)).otherwise(0.0)),
    )
    return {n: e.cast("double") for n, e in zip(FEATURES, exprs, strict=True)}


def classify_token(c: str | Column, rule: str = "prefix") -> Column:
    """yes, no or null for a decoded token. prefix: anything that begins with YES or NO, and Y, YE, N; exact: only YES, YE, Y, NO, N."""
    if rule not in ("prefix", "exact"):
        raise ValueError(f"unknown rule {rule}")
    t = F.upper(F.btrim(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\r\x0b\x0c")), F.lit('":*')))
    if rule == "prefix":
        return F.when(t.startswith("YES") | t.isin("Y", "YE"), "yes").when(t.startswith("NO") | (t == "N"), "no")
    return F.when(t.isin("YES", "Y", "YE"), "yes").when(t.isin("NO", "N"), "no")
