"""Ratios and scores as Column functions over line counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import tables as t


def round2(value: Column) -> Column:
    """Two decimals, half away from zero on the binary double."""
    return F.round(value * 100, 0) / 100


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def ratios(total: Column, code: Column, comment: Column, doc: Column, blank: Column) -> dict[str, Column]:
    """The six rounded ratios."""
    return {
        "code_ratio": round2(ratio(code, total)),
        "comment_ratio": round2(ratio(comment, total)),
        "doc_ratio": round2(ratio(doc, total)),
        "blank_ratio": round2(ratio(blank, total)),
        "comment_to_code": round2(ratio(comment, code)),
        "doc_to_code": round2(ratio(doc, code)),
    }


def _toward(value: Column, goal: float) -> Column:
    return F.least(F.lit(1.0), value / goal)


def documentation(r: dict[str, Column]) -> Column:
    score = (
        40 * _toward(r["doc_ratio"], t.DOC_GOAL)
        + 30 * _toward(r["comment_ratio"], t.COMMENT_GOAL)
        + 15 * _toward(r["doc_to_code"], t.DOC_TO_CODE_GOAL)
        + 15 * _toward(r["comment_to_code"], t.COMMENT_TO_CODE_GOAL)
    )
    return F.least(F.lit(100.0), score)


def maintainability(r: dict[str, Column]) -> Column:
    over = r["blank_ratio"] - t.BLANK_MOST
    spaced = F.when(over <= 0, 10.0).otherwise(F.greatest(F.lit(0.0), 10 - 20 * over))
    return 40 * r["code_ratio"] + 25 * _toward(r["comment_ratio"], t.COMMENT_GOAL) + 25 * _toward(r["doc_ratio"], t.DOC_GOAL) + spaced


def readability(r: dict[str, Column]) -> Column:
    best = t.BLANK_MOST / 2
    blank = r["blank_ratio"]
    spaced = F.when(blank <= best, 30 * (blank / best)).otherwise(F.greatest(F.lit(0.0), 30 - 60 * (blank - best)))
    return 70 * _toward(r["comment_ratio"], t.COMMENT_GOAL) + spaced


def evenness(ratio_column: Column) -> Column:
    """Aggregate: 100 for equal ratios down to 0 at a population deviation of 0.2."""
    return 100 * ((0.2 - F.least(F.stddev_pop(ratio_column), F.lit(0.2))) / 0.2)


def overall(documentation_: Column, maintainability_: Column, readability_: Column, consistency_: Column) -> Column:
    return documentation_ * 0.25 + maintainability_ * 0.35 + readability_ * 0.25 + consistency_ * 0.15


def quality_level(score: Column) -> Column:
    """Name of a score, cut to a whole number first; out of 0..100 and under 60 is very poor."""
    s = score.cast("int")
    return F.when((s >= 90) & (s <= 100), "Excellent").when((s >= 80) & (s < 90), "Good").when((s >= 70) & (s < 80), "Fair").when((s >= 60) & (s < 70), "Poor").otherwise("Very Poor")


def complexity_level(cyclomatic: Column) -> Column:
    c = cyclomatic.cast("int")
    return F.when(c.between(1, 5), "very_low").when(c.between(6, 10), "low").when(c.between(11, 20), "medium").when(c.between(21, 50), "high").otherwise("very_high")


def documentation_coverage(code: Column, comment: Column, doc: Column) -> Column:
    return F.when(code == 0, 0.0).otherwise(F.least(F.lit(100.0), (comment + doc) / code * 100 * 5))


def duplication_estimate(total: Column, code: Column, comment: Column, doc: Column) -> Column:
    """Guess in percent from a file's size, density and comments, 0 to 25."""
    tier = F.when(total > 2000, 12.0).when(total > 1000, 8.0).when(total > 500, 5.0).otherwise(2.0)
    dense = F.when(code / F.greatest(total, F.lit(1)) > 0.8, 3.0).otherwise(0.0)
    told = (comment + doc) / F.greatest(code, F.lit(1))
    documented = F.when(told > 0.2, -2.0).when(told < 0.05, 2.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(25.0), tier + dense + documented))


def project_duplication(lines: Column) -> Column:
    """Guess in percent from a project's lines."""
    return F.when(lines > 10000, 20.0).when(lines > 5000, 15.0).when(lines > 1000, 10.0).otherwise(5.0)


def file_risk(total: Column, code: Column, comment: Column) -> Column:
    """1 to 10, from size, density and lack of comments."""
    size = F.when(total > 500, 3.0).when(total > 200, 1.5).otherwise(0.0)
    density = F.when(ratio(code, total) > 0.8, 2.0).when(ratio(code, total) > 0.6, 1.0).otherwise(0.0)
    bare = F.when(ratio(comment, total) < 0.05, 1.5).when(ratio(comment, total) < 0.1, 0.5).otherwise(0.0)
    return F.least(F.lit(10.0), 1 + size + density + bare)


def risk_level(risk: Column) -> Column:
    return F.when(risk > 7, "HIGH").when(risk > 4, "MEDIUM").otherwise("LOW")


def minutes(code: Column) -> Column:
    """Writing time: half a minute per line of code."""
    return code * 0.5


# ---- text forms -------------------------------------------------------------------------


def grouped_number(value: Column) -> Column:
    return F.format_number(value, 0)


def one_decimal(value: Column) -> Column:
    """One decimal of the exact binary value, halves to even; ``%.1f`` on the JVM rounds the shortest digits, halves up."""
    return F.call_function("format_number", value, F.lit("0.0"))


def told(pattern: str, *values: Column) -> Column:
    """``format_string`` with ``%.1f`` as ``one_decimal``."""
    kinds = [k for k in re.findall(r"%(?:%|\.1f|[a-z])", pattern) if k != "%%"]
    return F.format_string(pattern.replace("%.1f", "%s"), *(one_decimal(v) if k == "%.1f" else v for k, v in zip(kinds, values, strict=True)))


def human_size(size: Column) -> Column:
    """Bytes in steps of 1024 with one decimal, plain under 1 KB, up to TB."""
    step = lambda k: one_decimal(size / float(1024**k))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(step(1), F.lit(" KB")))
        .when(size < 1024**3, F.concat(step(2), F.lit(" MB")))
        .when(size < 1024**4, F.concat(step(3), F.lit(" GB")))
        .otherwise(F.concat(step(4), F.lit(" TB")))
    )


def percent(value: Column) -> Column:
    return F.concat(one_decimal(value), F.lit("%"))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def script_escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
