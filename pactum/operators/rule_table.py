"""The default rule table, and reading another one.

A rule table is data: ``read_rules`` takes any JSON file of the same shape, so other
messages, limits of scope or law versions need no code. The advice texts below are this
library's own; placeholders ``{value} {limit} {days} {position} {deadline}`` are filled when
a finding is built.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "id string, kind string, title string, categories array<string>, fields array<string>, "
    "check string, detect string, articles array<string>, "
    "article_refs array<struct<source:string,article:string,paragraph:string>>, "
    "severity_if_fail string, impact string, employee_msg string, hr_msg string, "
    "ask_for string, suggested_wording string, good_msg string, confidence string, "
    "rule_order int"
)
MAX_RULES = 10_000

LAW, REG, TEMPLATE = "labor_law", "implementing_regulations", "qiwa_template"


def _rule(
    id: str,
    kind: str,
    title: str,
    categories: str,
    severity: str,
    refs: list[tuple],
    articles: list[str],
    employee: str,
    hr: str,
    *,
    detect: bool = False,
    ask: str | None = None,
    wording: str | None = None,
    good: str | None = None,
    impact: str | None = None,
    fields: str = "",
    confidence: str = "high",
) -> dict:
    return {
        "id": id,
        "kind": kind,
        "title": title,
        "categories": categories.split(),
        "fields": fields.split(),
        "check": None,
        "detect": title if detect else None,
        "articles": articles,
        "articleRefs": [
            {"source": r[0], "article": r[1], **({"paragraph": r[2]} if len(r) > 2 else {})}
            for r in refs
        ],
        "severityIfFail": severity,
        "impact": impact,
        "employeeMsg": employee,
        "hrMsg": hr,
        "askFor": ask,
        "suggestedWording": wording,
        "goodMsg": good,
        "confidence": confidence,
    }


RULESET_VERSION = "0.1.0"
LAW_VERSION = "2025-11"

# Ids, titles, kinds, categories, severities, citations and references per rule.
DEFAULT_RULES: list[dict] = [
    _rule(
        "PROB-MAX-01", "field", "Probation of 180 days or less", "legal", "high",
        [(LAW, "53"), (REG, "19")], ["Art. 53", "Exec. Reg. Art. 19"],
        "Probation runs past the 180 days the law permits; the extra days are likely void.",
        "Cut probation to 180 days in total; anything beyond is likely void (Art. 53).",
        detect=True, fields="probation_days",
        ask="A probation of at most 180 days.",
        wording="Probation lasts [N] days and never more than 180 days in total.",
        good="Your {value} days of probation stay within the 180 days the law permits.",
    ),
    _rule(
        "PROB-EXCL-01", "field", "Only the permitted days pause probation", "legal", "medium",
        [(LAW, "53"), (REG, "19")], ["Art. 53", "Exec. Reg. Art. 19"],
        "Days that the regulations do not list pause your probation.",
        "Pause probation only for the days Exec. Reg. Art. 19 lists.",
        fields="probation_excluded_days",
        ask="Only the two Eids, National Day, Foundation Day and sick leave as pauses.",
        wording="The two Eids, National Day, Foundation Day and sick leave are not counted.",
        good="Probation is paused only by days the regulations list.",
    ),
    _rule(
        "PROB-NOCOMP-01", "info", "No compensation if the contract ends during probation",
        "legal", "none", [(LAW, "54")], ["Art. 54"],
        "While probation runs, either side may end the contract without compensation.",
        "Ending the contract in probation triggers no compensation or award (Art. 54).",
    ),
    _rule(
        "LEAVE-MIN-01", "field", "At least 21 days' annual leave (30 after 5 years)",
        "legal", "high", [(LAW, "109", "1")], ["Art. 109"],
        "Annual leave is under the minimum of 21 days a year (30 after five years).",
        "Annual leave is under the Art. 109 minimum; the missing days can be claimed.",
        detect=True, impact="leave_value", fields="annual_leave_days",
        ask="At least 21 days of paid leave a year, 30 after five years.",
        wording="Annual leave is [21 or more] days, and at least 30 after five years.",
        good="You get {value} days of leave a year; the minimum is 21, then 30 after 5 years.",
    ),
    _rule(
        "LEAVE-FORFEIT-01", "clause", "Untaken leave can't be forfeited", "legal", "medium",
        [(LAW, "109"), (LAW, "110"), (LAW, "111"), (LAW, "8")], ["Arts. 109-111", "Art. 8"],
        "Carry-over may be refused, but unused leave must still be paid when you go.",
        "Refusing carry-over is lawful; forfeiting or not paying untaken leave is not.",
        detect=True,
        ask="Payment for any leave not taken when the contract ends.",
        wording="Leave not taken when the contract ends is paid under Article 111.",
    ),
    _rule(
        "HOURS-MAX-01", "field", "Normal hours within 8 a day and 48 a week", "legal", "high",
        [(LAW, "98")], ["Art. 98"],
        "Normal hours exceed 8 a day or 48 a week; the excess counts as overtime.",
        "Normal hours exceed the Art. 98 limits; treat the excess as overtime.",
        detect=True, fields="daily_hours weekly_hours",
        ask="Normal hours within 8 a day and 48 a week.",
        wording="Normal hours are at most 8 a day or 48 a week (6 or 36 in Ramadan).",
        good="Your week is {value} hours, within the cap of 48.",
    ),
    _rule(
        "OT-RATE-01", "field", "Overtime paid at the hourly wage plus 50% of basic",
        "legal", "high", [(LAW, "107")], ["Art. 107"],
        "Overtime must pay the hourly wage plus half the basic hourly wage.",
        "Overtime terms fall under Art. 107: hourly wage plus 50% of the basic hourly wage.",
        detect=True, fields="overtime_premium_pct",
        ask="Overtime at the hourly wage plus 50% of basic, time off only if you agree.",
        wording="Overtime is paid at the hourly wage plus 50% of the basic hourly wage.",
        good="Overtime pays a premium of {value}% of basic; the minimum is 50%.",
    ),
    _rule(
        "EOS-BASE-01", "clause", "End-of-service award on the actual wage", "legal", "high",
        [(LAW, "2"), (LAW, "84"), (LAW, "86"), (LAW, "8"), (TEMPLATE, "14.5")],
        ["Art. 2", "Art. 84", "Art. 8"],
        "The award must use your full actual wage, so a smaller base is likely void.",
        "Base the award on the last actual wage; a smaller base is likely void.",
        detect=True, impact="eos_gap",
        ask="The award on your last actual wage.",
        wording="The award is calculated on the last actual wage under Article 84.",
    ),
    _rule(
        "COMP-ART77-01", "clause",
        "Fixed compensation for ending the contract without a valid reason", "market", "medium",
        [(LAW, "77")], ["Art. 77"],
        "A fixed amount replaces the wages for the rest of your term and may be far less.",
        "Lawful under Art. 77; measure the amount on the actual wage to keep the floor.",
        detect=True, impact="art77_gap",
        ask="At least two months of total wage, or no fixed amount.",
        wording="Compensation is [N] months of the actual wage and at least two.",
    ),
    _rule(
        "TYPE-CONFLICT-01", "cross", "Section 15 contradicts the contract type",
        "legal clarity", "high",
        [(TEMPLATE, "14.5"), (TEMPLATE, "14.8.1"), (TEMPLATE, "5.1"), (LAW, "74"), (LAW, "55")],
        ["Contract cl. 14.5", "Contract cl. 14.8.1", "Art. 74"],
        "The contract disagrees with itself on its length; the recorded type likely wins.",
        "Section 15 contradicts the recorded type; change the type or drop the term.",
        detect=True, fields="contract_type end_date term_months",
        ask="One clear answer on the contract's type.",
        wording="Delete the clause, or change the contract type on the portal.",
    ),
    _rule(
        "TYPE-ART57-01", "clause", "Project-based ending without a defined project",
        "clarity", "high", [(LAW, "57")], ["Art. 57"],
        "The job ends with a project that is not defined, so its end is uncertain.",
        "Define the work (scope, deliverable, end criterion) or rely on the fixed term.",
        detect=True,
        ask="A written definition of the project, or the clause removed.",
        wording="The contract is for [defined work] and ends when [criterion] is met.",
    ),
    _rule(
        "RENEW-CONVERT-01", "info", "Renewed fixed-term contracts become open-ended",
        "legal", "none", [(LAW, "55", "2")], ["Art. 55(2)"],
        "After three renewals in a row, or four years, the contract becomes open-ended.",
        "Track renewals: three in a row or four years make it indefinite (Art. 55(2)).",
        fields="contract_type nationality",
    ),
    _rule(
        "RENEW-DEADLINE-01", "field", "Non-renewal notice deadline", "clarity", "none",
        [(TEMPLATE, "5.1"), (TEMPLATE, "14.1")], ["Contract cl. 5.1", "Contract cl. 14.1"],
        "Give notice by {deadline} to stop the automatic renewal.",
        "Non-renewal notice is due by {deadline}; a late notice renews the term.",
        fields="end_date renewal_notice_days auto_renew",
    ),
    _rule(
        "NOTICE-INDEF-01", "info", "Notice periods on an open-ended contract",
        "legal", "none", [(LAW, "75"), (LAW, "76")], ["Art. 75", "Art. 76"],
        "Resigning needs 30 days' written notice; your employer must give you 60.",
        "Indefinite contracts need 60 days' notice from the employer, 30 from the worker.",
        fields="contract_type",
    ),
    _rule(
        "TRANSFER-KSA-01", "clause", "Transfer anywhere in the Kingdom", "market", "medium",
        [(LAW, "58"), (REG, "20")], ["Art. 58", "Exec. Reg. Art. 20"],
        "Lawful, but you agree in advance to relocate anywhere in the Kingdom.",
        "Enforceable as written consent to relocation; keep it only if needed.",
        detect=True,
        ask="A limit to your city, or your consent and costs for each move.",
        wording="Transfers outside [city] need the worker's written consent.",
    ),
    _rule(
        "NONCOMPETE-01", "clause", "Non-compete after the contract ends", "legal", "high",
        [(LAW, "83", "1")], ["Art. 83(1)"],
        "This non-compete likely does not hold: it is not limited as the law requires.",
        "Limit it in time (two years), place and work, and tie it to client access.",
        detect=True,
        ask="Removal, or at most two years, a named area and your role.",
        wording="For [N, at most 24] months, in [city], in a [specific role] only.",
    ),
    _rule(
        "CONFIDENTIAL-01", "clause", "Confidentiality with no limits", "clarity", "low",
        [(LAW, "83", "2"), (LAW, "65", "6")], ["Art. 83(2)"],
        "Keeping secrets is standard, but this duty has no end and no limits.",
        "Give the duty a scope and a time limit (Art. 83(2)).",
        detect=True,
        ask="What counts as confidential, and for how long after you leave.",
        wording="For [N] years after the end, [defined information] is kept secret.",
    ),
    _rule(
        "SETTLE-TIME-01", "info", "Final pay deadline", "legal", "none",
        [(LAW, "88")], ["Art. 88"],
        "Final pay is due within one week, or two weeks if you resign.",
        "Settle final dues within one week, or two when the worker ends it (Art. 88).",
    ),
    _rule(
        "MARKET-ALLOW-01", "market", "Housing and transport allowances vs market norm",
        "market", "low", [], [],
        "Your allowances are {position} the usual split; a convention, not a duty.",
        "The allowance split is {position} the market convention; not a duty.",
        fields="wage", confidence="medium",
        ask="Housing near 25% of basic and transport near 10%.",
        wording="Housing allowance [25]% and transport allowance [10]% of basic.",
        good="Your allowances are {position} the usual split (25% and 10% of basic).",
    ),
]


@dataclass(frozen=True)
class RuleSet:
    """A validated rule table and its versions. Rules are few and held by the driver."""

    rules: tuple[dict, ...]
    ruleset_version: str = RULESET_VERSION
    law_version: str = LAW_VERSION
    _by_id: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        if len(self.rules) > MAX_RULES:
            raise ValueError(f"a rule table holds at most {MAX_RULES} rules")
        seen = set()
        for rule in self.rules:
            if rule["id"] in seen:
                raise ValueError(f"duplicate rule id {rule['id']}")
            seen.add(rule["id"])

    def rows(self) -> list[tuple]:
        names = (
            "id kind title categories fields check detect articles articleRefs severityIfFail "
            "impact employeeMsg hrMsg askFor suggestedWording goodMsg confidence"
        ).split()
        out = []
        for order, rule in enumerate(self.rules):
            row = [rule.get(n) for n in names]
            row[8] = [
                (r["source"], r["article"], r.get("paragraph")) for r in rule["articleRefs"]
            ]
            out.append((*row, order))
        return out

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), RULE_SCHEMA)

    def packed(self, spark: SparkSession) -> DataFrame:
        """One struct column ``rule``, for a broadcast join (at most ``MAX_RULES`` rows)."""
        return F.broadcast(self.df(spark).select(F.struct("*").alias("rule")))

    def candidates(self) -> "RuleSet":
        """Rules a Section 15 clause can match."""
        keep = tuple(
            r
            for r in self.rules
            if r["kind"] == "clause" or (r["kind"] == "field" and r.get("detect") is not None)
        )
        return RuleSet(keep, self.ruleset_version, self.law_version)

    def of_kind(self, *kinds: str) -> list[dict]:
        return [r for r in self.rules if r["kind"] in kinds]


def default_rules() -> RuleSet:
    return RuleSet(tuple(DEFAULT_RULES))


def read_rules(spark: SparkSession, path: str) -> RuleSet:
    """A rule table from a (multi-line) JSON file on any file system Spark can read."""
    text = spark.read.text(path, wholetext=True).first()[0]
    data = json.loads(text)
    return RuleSet(tuple(data["rules"]), data["rulesetVersion"], data["lawVersion"])


def candidate_rules(rules: DataFrame) -> DataFrame:
    """The same choice over a rules DataFrame."""
    kind = F.col("kind")
    return rules.where((kind == "clause") | ((kind == "field") & F.col("detect").isNotNull()))
