"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators.rule_table import DEFAULT_RULES, default_rules
from pactum.workload.views import load

RULES = default_rules()


def contract_fields(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """The contract view with its wage struct and the excluded days as an array."""
    f = load(spark, sf, "contract_fields", parts=parts)
    wage = F.when(
        F.col("basic").isNotNull(),
        F.struct(
            *[F.col(c).cast("double").alias(c) for c in ("basic", "housing", "transport", "other", "total")]
        ),
    )
    days = F.filter(F.split("excluded_days", ","), lambda d: d != "")
    return f.withColumns({"wage": wage, "probation_excluded_days": days})


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def rules_values() -> str:
    """The default rules as a VALUES list for an oracle."""
    rows = []
    for n, r in enumerate(DEFAULT_RULES):
        cells = [
            str(n), q(r["id"]), q(r["kind"]), q(r["title"]), q(",".join(r["categories"])),
            q(",".join(r["articles"])), q(r["severityIfFail"]), q(r["impact"]), q(r["goodMsg"]),
            q(r["employeeMsg"]), q(r["hrMsg"]), q(r["confidence"]),
            "true" if r["detect"] is not None else "false",
        ]
        rows.append("(" + ",".join(cells) + ")")
    names = (
        "rule_order, rule_id, kind, title, categories, articles, severity_if_fail, impact, "
        "good_msg, employee_msg, hr_msg, confidence, has_detect"
    )
    return f"rules({names}) AS (VALUES " + ",\n".join(rows) + ")"
