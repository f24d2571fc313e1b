"""Placeholder filling and the choice of texts a finding carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.operators.verdicts import is_problem


def fill(template: Column, values: Column) -> Column:
    """Replaces every ``{name}`` that has a value; unknown names stay."""
    return F.when(
        template.contains("{"),
        F.aggregate(
            F.map_entries(values),
            template,
            lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
        ),
    ).otherwise(template)


def can_fill(template: Column, values: Column) -> Column:
    names = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    return F.forall(names, lambda name: F.map_contains_key(values, name))


def finding_texts(verdict: Column, values: Column, rule: str = "rule") -> list[Column]:
    """``employee_msg, hr_msg, ask_for, suggested_wording`` from the joined rule columns."""
    r = lambda name: F.col(f"{rule}.{name}")
    problem, info = is_problem(verdict), r("kind") == "info"
    bad = info | problem
    good = F.when(
        r("good_msg").isNotNull() & can_fill(r("good_msg"), values), fill(r("good_msg"), values)
    ).otherwise(r("title"))
    action = problem & ~info
    return [
        F.when(bad, fill(r("employee_msg"), values)).otherwise(good).alias("employee_msg"),
        F.when(bad, fill(r("hr_msg"), values)).otherwise(r("title")).alias("hr_msg"),
        F.when(action, r("ask_for")).alias("ask_for"),
        F.when(action, r("suggested_wording")).alias("suggested_wording"),
    ]
