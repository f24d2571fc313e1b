"""Sub-scores, weighted overall scores of both views, caps, bands, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.operators.verdicts import REVIEW_RULE_ID, is_problem

# Fixed values.
CATEGORIES = ("legal", "market", "clarity")
SEVERITY_PENALTY = {"high": 20, "medium": 8, "low": 3}
BETTER_THAN_LAW_BONUS = 2
VIEW_WEIGHTS = {
    "employee": {"legal": 40, "market": 35, "clarity": 25},
    "hr": {"legal": 60, "market": 10, "clarity": 30},
}
BANDS = ((80, "Good"), (60, "Fair"), (40, "Weak"))
LOWEST_BAND = "Poor"
OVERALL_CAPS = ((3, 59), (1, 79))
UNANALYSED_CLAUSE_REASON = (
    "One or more Section 15 clauses could not be analysed automatically; check them by hand."
)


def band_for(overall: Column) -> Column:
    band = F.lit(LOWEST_BAND)
    for minimum, name in reversed(BANDS):
        band = F.when(overall >= minimum, name).otherwise(band)
    return band


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")


def _times_listed(category: str) -> Column:
    return F.size(F.filter("categories", lambda x: x == category))


def sub_scores(findings: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """``contract_id, legal, market, clarity, serious``.

    Category lists are counted in place rather than exploded, so one partial aggregation runs
    before the only shuffle. ``contracts`` adds the contracts that have no finding.
    """
    penalty = F.lit(0)
    for severity, points in SEVERITY_PENALTY.items():
        penalty = F.when(F.col("severity") == severity, points).otherwise(penalty)
    verdict = F.col("verdict")
    rows = findings.where("source <> 'info'").select(
        "contract_id",
        F.when(is_problem(verdict), penalty).otherwise(0).alias("penalty"),
        F.when(verdict == "better_than_law", F.col("categories")[0]).alias("bonus"),
        "categories",
        (
            (F.col("severity") == "high") & verdict.isin("likely_void", "conflict")
        ).alias("serious"),
    )
    if contracts is not None:
        rows = rows.unionByName(
            contracts.select(
                "contract_id",
                F.lit(0).alias("penalty"),
                F.lit(None).cast("string").alias("bonus"),
                F.array().cast("array<string>").alias("categories"),
                F.lit(False).alias("serious"),
            )
        )
    aggs = []
    for c in CATEGORIES:
        listed = _times_listed(c)
        points = F.when(F.col("bonus") == c, BETTER_THAN_LAW_BONUS).otherwise(0)
        aggs.append(_clamp(F.lit(100) + F.sum(points - F.col("penalty") * listed)).alias(c))
    return rows.groupBy("contract_id").agg(*aggs, F.count_if("serious").alias("serious"))


def overall_scores(subs: DataFrame, capped: bool = True) -> DataFrame:
    """One row per contract and view. The band is read after the cap."""
    cap = F.lit(100)
    for at_least, limit in reversed(OVERALL_CAPS):
        cap = F.when(F.col("serious") >= at_least, limit).otherwise(cap)
    views = []
    for view, weights in VIEW_WEIGHTS.items():
        weighted = sum((F.col(c) * w for c, w in weights.items()), F.lit(0))
        # Integers: floor((w + 50) / 100) rounds halves up.
        overall = _clamp(F.floor((weighted + 50) / 100))
        if capped:
            overall = F.least(overall, cap)
        views.append(F.struct(F.lit(view).alias("view"), overall.cast("int").alias("overall")))
    return subs.select(
        "contract_id", *CATEGORIES, "serious", F.inline(F.array(*views))
    ).select(
        "contract_id",
        "view",
        *CATEGORIES,
        "overall",
        band_for(F.col("overall")).alias("band"),
        F.lit("low").alias("market_confidence"),
    )


def score_both_views(findings: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    return overall_scores(sub_scores(findings, contracts))


def rating_status(contracts: DataFrame, findings: DataFrame) -> DataFrame:
    """``needs_review`` when extraction or any finding asks for it.

    ``contracts``: ``contract_id, needs_review`` and optionally ``detected`` (rejected
    documents are left out).
    """
    if "detected" in contracts.columns:
        contracts = contracts.where("detected")
    stacked = contracts.select("contract_id", "needs_review", F.lit(True).alias("known")).unionByName(
        findings.select("contract_id", "needs_review", F.lit(False).alias("known"))
    )
    by_contract = stacked.groupBy("contract_id").agg(
        F.bool_or("needs_review").alias("review"), F.bool_or("known").alias("known")
    )
    status = F.when(F.col("review"), "needs_review").otherwise("done")
    return by_contract.where("known").select("contract_id", status.alias("status"))


def review_reasons(contracts: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct reasons in order: extraction issues, then the unanalysed-clause line.

    ``contracts``: ``contract_id, status, issues array<struct<field,message>>``.
    """
    unread = (
        findings.where(F.col("rule_id") == REVIEW_RULE_ID)
        .groupBy("contract_id")
        .agg(F.lit(True).alias("unread"))
    )
    extra = F.when(F.col("unread"), F.array(F.lit(UNANALYSED_CLAUSE_REASON))).otherwise(
        F.array().cast("array<string>")
    )
    messages = F.transform("issues", lambda i: i["message"])
    reasons = F.array_distinct(F.concat(messages, extra))
    return contracts.join(unread, "contract_id", "left").select(
        "contract_id",
        F.when(F.col("status") == "done", F.array().cast("array<string>"))
        .otherwise(reasons)
        .alias("reasons"),
    )
