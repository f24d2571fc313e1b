"""Money impact of problem findings.

Findings meet their contract's fields in one join on ``contract_id``; every formula is a
column expression, so the later aggregation by contract reuses the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.dates import term_months
from pactum.functions.numbers import round_half_up
from pactum.operators.verdicts import is_problem

# Fixed values.
ANNUAL_LEAVE_MIN_DAYS = 21
DAYS_PER_MONTH = 30
ART77_FLOOR_MONTHS = 2
ART77_ESCALATION_MONTHS = 6
HEADLINE_KEY = {"eos_gap": "5y", "art77_gap": "gap", "leave_value": "perYear"}
IMPACT_COLUMNS = {
    "eos_gap": ["1y", "5y", "10y"],
    "art77_gap": ["contract", "default", "gap"],
    "leave_value": ["perYear"],
}
AT_LEAST_DEFAULT_MSG = (
    "The fixed compensation is at least what Art. 77 would pay by default."
)
AT_LEAST_DEFAULT_NOTE = " The fixed amount is at least the legal default."

IMPACT_TYPE = "struct<kind:string,sar:map<string,double>,note:string>"
FIELD_COLUMNS = (
    "wage contract_type term_months commencement_date end_date annual_leave_days"
).split()


def _sar(kind: str, note: Column, figures: list[Column]) -> Column:
    pairs = []
    for key, value in zip(IMPACT_COLUMNS[kind], figures, strict=True):
        pairs += [F.lit(key), round_half_up(value)]
    return F.struct(
        F.lit(kind).alias("kind"), F.create_map(*pairs).alias("sar"), note.alias("note")
    ).cast(IMPACT_TYPE)


def eos_gap() -> Column:
    """Award lost on a basic-only base after 1, 5 and 10 years."""
    gap = F.col("f.wage.total") - F.col("f.wage.basic")
    note = F.lit("Award lost by using basic instead of actual wage, after 1, 5 and 10 years.")
    figures = [gap / 2, gap / 2 * 5, gap / 2 * 5 + gap * 5]
    return F.when(
        (F.col("impact_params.eos_base") == "basic") & (gap > 0), _sar("eos_gap", note, figures)
    )


def leave_value() -> Column:
    """Yearly value of the missing leave days; a clause finding states no day count."""
    missing = F.lit(ANNUAL_LEAVE_MIN_DAYS) - F.col("f.annual_leave_days")
    value = missing * (F.col("f.wage.total") / DAYS_PER_MONTH)
    note = F.concat(
        missing.cast("string"), F.lit(" days of leave a year below the minimum, at the daily wage.")
    )
    return F.when(
        (F.col("source") != "clause") & (missing > 0) & F.col("f.wage").isNotNull(),
        _sar("leave_value", note, [value]),
    )


def apply_impact(findings: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds ``impact``; an Art. 77 clause may change verdict, severity and texts."""
    f = fields.select("contract_id", *FIELD_COLUMNS).alias("f")
    joined = findings.alias("x").join(f, "contract_id", "left")
    term = F.when(
        F.col("f.contract_type") == "fixed_term",
        term_months(
            F.col("f.term_months"), F.col("f.commencement_date"), F.col("f.end_date")
        ),
    )
    months = F.col("impact_params.compensation_months")
    base = F.when(
        F.col("impact_params.compensation_base") == "basic", F.col("f.wage.basic")
    ).otherwise(F.col("f.wage.total"))
    problem = is_problem(F.col("verdict"))
    joined = joined.withColumns(
        {
            "_problem": problem,
            "_term": term,
            "_pays": months * base,
            "_default": F.col("f.wage.total") * F.coalesce(term, F.lit(ART77_FLOOR_MONTHS)),
            "_eos": eos_gap(),
            "_leave": leave_value(),
            "_total": F.col("f.wage.total"),
        }
    )
    priced77 = (
        F.col("_problem") & (F.col("impact_kind") == "art77_gap") & F.col("_pays").isNotNull()
    )
    gap = F.col("_default") - F.col("_pays")
    passes = F.coalesce(priced77 & (gap <= 0), F.lit(False))
    escalates = (
        priced77
        & (F.col("verdict") == "worse_than_default")
        & (gap >= F.col("_total") * ART77_ESCALATION_MONTHS)
    )
    note77 = F.when(
        F.col("_term").isNotNull(),
        F.concat(
            F.lit("Legal default: wages for the rest of the term, up to "),
            F.col("_term").cast("string"), F.lit(" months."),
        ),
    ).otherwise("Legal default at the Art. 77 floor of two months' wage.")
    impact = (
        F.when(~F.col("_problem"), F.lit(None).cast(IMPACT_TYPE))
        .when(F.col("impact_kind") == "eos_gap", F.col("_eos"))
        .when(F.col("impact_kind") == "leave_value", F.col("_leave"))
        .when(priced77, _sar("art77_gap", note77, [F.col("_pays"), F.col("_default"), gap]))
    )
    changed = {
        "impact": impact,
        "verdict": F.when(passes, "compliant").otherwise(F.col("verdict")),
        "severity": F.when(passes, "none").when(escalates, "high").otherwise(F.col("severity")),
    }
    for text in ("employee_msg", "hr_msg"):
        if text in findings.columns:
            changed[text] = F.when(passes, AT_LEAST_DEFAULT_MSG).otherwise(F.col(text))
    for text in ("ask_for", "suggested_wording"):
        if text in findings.columns:
            changed[text] = F.when(~passes, F.col(text))
    if "explanation" in findings.columns:
        changed["explanation"] = F.when(
            passes, F.concat(F.col("explanation"), F.lit(AT_LEAST_DEFAULT_NOTE))
        ).otherwise(F.col("explanation"))
    kept = [c for c in findings.columns if c not in ("impact_params", "impact")]
    return joined.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in kept],
        impact.alias("impact"),
    )


def sar_at_stake(impact: Column) -> Column:
    """The headline figure of an impact, else its largest, else 0."""
    sar = impact["sar"]
    headline = F.lit(None).cast("double")
    for kind, key in HEADLINE_KEY.items():
        headline = F.when(impact["kind"] == kind, F.try_element_at(sar, F.lit(key))).otherwise(
            headline
        )
    return F.coalesce(headline, F.array_max(F.map_values(sar)), F.lit(0.0))


def impact_columns(impact: Column) -> Column:
    """Figure names in display order: the kind's own order, else as they come."""
    keys = F.map_keys(impact["sar"])
    out = keys
    for kind, order in IMPACT_COLUMNS.items():
        known = F.array(*[F.lit(k) for k in order])
        out = F.when(
            impact["kind"] == kind,
            F.filter(known, lambda k: F.map_contains_key(impact["sar"], k)),
        ).otherwise(out)
    return out
