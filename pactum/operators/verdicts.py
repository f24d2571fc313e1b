"""Verdict predicates and ranks shared by scoring, impact and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PROBLEM_VERDICTS = ("likely_void", "conflict", "worse_than_default", "unclear")
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "none": 3}
LEGAL_RISK_RANK = {
    "likely_void": 0,
    "conflict": 1,
    "worse_than_default": 2,
    "unclear": 3,
    "compliant": 4,
    "better_than_law": 5,
}
REVIEW_RULE_ID = "REVIEW-00"


def is_problem(verdict: Column) -> Column:
    return verdict.isin(*PROBLEM_VERDICTS)


def rank(value: Column, ranks: dict[str, int]) -> Column:
    expr = F.lit(None).cast("int")
    for name, n in reversed(ranks.items()):
        expr = F.when(value == name, F.lit(n)).otherwise(expr)
    return expr
