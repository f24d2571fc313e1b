"""Rules over a contract's own fields.

A check is a function ``fields -> Column`` giving a nullable
``struct<verdict, explanation, values>``; null means the check has nothing to say. Registries
are plain dictionaries, so a caller adds checks, deadlines or conditions by key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.dates import term_months
from pactum.functions.numbers import short_number, thousands
from pactum.operators.messages import fill, finding_texts
from pactum.operators.rule_table import RuleSet
from pactum.operators.verdicts import is_problem

Check = Callable[[], Column]
DeadlineCheck = Callable[[Column], Column]
Condition = Callable[[], Column]

# Legal limits and market norms.
PROBATION_MAX_DAYS = 180
ANNUAL_LEAVE_MIN_DAYS = 21
DAILY_HOURS_MAX = 8
WEEKLY_HOURS_MAX = 48
OVERTIME_PREMIUM_MIN_PCT = 50
HOUSING_NORM = (25, 5)
TRANSPORT_NORM = (10, 3)
ALLOWED_EXCLUSIONS = (
    "eid_al_fitr",
    "eid_al_adha",
    "national_day",
    "foundation_day",
    "sick_leave",
)
TEMPLATE_CLAUSE = {
    "PROB-MAX-01": "6.1",
    "PROB-EXCL-01": "6.1",
    "PROB-NOCOMP-01": "6.2",
    "LEAVE-MIN-01": "8.1",
    "HOURS-MAX-01": "7",
    "OT-RATE-01": "11.2",
    "RENEW-CONVERT-01": "5.1",
    "RENEW-DEADLINE-01": "5.1",
    "MARKET-ALLOW-01": "9.1.1",
}
PROBATION_END_MSG = (
    "Probation ends on {deadline} at the earliest; until then either side may leave freely.",
    "Probation ends on {deadline} at the earliest (excluded days push it later).",
)
#: A renewal date is looked for at most so many terms ahead; beyond them there is none.
MAX_TERMS_TO_ROLL = 100

VALUES_TYPE = "map<string,string>"
OUTCOME_TYPE = f"struct<verdict:string,explanation:string,values:{VALUES_TYPE}>"


def _outcome(verdict: Column, explanation: Column, **values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    filled = F.create_map(*pairs) if pairs else F.create_map()
    if pairs:
        filled = F.map_filter(filled, lambda _, v: v.isNotNull())
    return F.struct(
        verdict.alias("verdict"),
        explanation.alias("explanation"),
        filled.cast(VALUES_TYPE).alias("values"),
    )


def verdict_against_limit(value: Column, limit: int, limit_is: str) -> Column:
    kinder = value < limit if limit_is == "max" else value > limit
    return (
        F.when(value == limit, "compliant").when(kinder, "better_than_law").otherwise("likely_void")
    )


def check_probation_length() -> Column:
    days = F.col("probation_days")
    text = F.format_string(
        f"Probation is %d days; the legal maximum is {PROBATION_MAX_DAYS} days in total.", days
    )
    return F.when(
        days.isNotNull(),
        _outcome(
            verdict_against_limit(days, PROBATION_MAX_DAYS, "max"),
            text,
            value=days,
            limit=F.lit(PROBATION_MAX_DAYS),
        ),
    )


def check_probation_exclusions() -> Column:
    allowed = F.array(*[F.lit(d) for d in ALLOWED_EXCLUSIONS])
    outside = F.size(F.array_except("probation_excluded_days", allowed)) > 0
    return F.when(
        F.col("probation_days") > 0,
        _outcome(
            F.when(outside, "likely_void").otherwise("compliant"),
            F.when(outside, "Days outside the regulations' list also pause probation.").otherwise(
                "Only days on the regulations' list pause probation."
            ),
        ),
    )


# The sentences of the checks below are fixed values: results are compared by their text.
def check_annual_leave() -> Column:
    days = F.col("annual_leave_days")
    text = F.format_string(
        f"Annual leave is %d days a year; the legal minimum is {ANNUAL_LEAVE_MIN_DAYS} days "
        "(30 after 5 years of service).",
        days,
    )
    return F.when(
        days.isNotNull(),
        _outcome(
            verdict_against_limit(days, ANNUAL_LEAVE_MIN_DAYS, "min"),
            text,
            value=days,
            limit=F.lit(ANNUAL_LEAVE_MIN_DAYS),
            days=F.greatest(F.lit(0), F.lit(ANNUAL_LEAVE_MIN_DAYS) - days),
        ),
    )


def weekly_hours() -> Column:
    derived = F.col("daily_hours").cast("double") * F.col("work_days_per_week")
    return F.coalesce(F.col("weekly_hours").cast("double"), derived)


def check_working_hours() -> Column:
    daily, weekly = F.col("daily_hours").cast("double"), weekly_hours()
    zero = F.lit(0.0)
    over = (F.coalesce(daily, zero) > DAILY_HOURS_MAX) | (
        F.coalesce(weekly, zero) > WEEKLY_HOURS_MAX
    )
    # The week decides "better than the law"; the day only when the week is unknown.
    under = F.when(weekly.isNotNull(), weekly < WEEKLY_HOURS_MAX).otherwise(
        daily < DAILY_HOURS_MAX
    )
    stated = F.concat_ws(
        " and ",
        F.concat(short_number(daily), F.lit(" a day")),
        F.concat(short_number(weekly), F.lit(" a week")),
    )
    cap = F.when(
        daily.isNull(), f"{WEEKLY_HOURS_MAX} a week under the weekly criterion"
    ).otherwise(f"{DAILY_HOURS_MAX} a day and {WEEKLY_HOURS_MAX} a week")
    text = F.concat(
        F.lit("Normal hours are "), stated, F.lit("; the legal cap is "), cap, F.lit(".")
    )
    verdict = (
        F.when(over, "likely_void").when(under, "better_than_law").otherwise("compliant")
    )
    return F.when(
        daily.isNotNull() | weekly.isNotNull(),
        _outcome(verdict, text, value=short_number(weekly), limit=F.lit(WEEKLY_HOURS_MAX)),
    )


def check_overtime_premium() -> Column:
    pct = F.col("overtime_premium_pct").cast("double")
    text = F.concat(
        F.lit("Overtime pays the hourly wage plus "),
        short_number(pct),
        F.lit(
            "% of the basic hourly wage; the legal minimum is "
            f"{OVERTIME_PREMIUM_MIN_PCT}%."
        ),
    )
    return F.when(
        pct.isNotNull(),
        _outcome(
            verdict_against_limit(pct, OVERTIME_PREMIUM_MIN_PCT, "min"),
            text,
            value=short_number(pct),
            limit=F.lit(OVERTIME_PREMIUM_MIN_PCT),
        ),
    )


def check_allowances() -> Column:
    basic = F.col("wage.basic").cast("double")
    positive = F.when(basic > 0, basic)
    housing = F.col("wage.housing").cast("double") / positive * 100
    transport = F.col("wage.transport").cast("double") / positive * 100

    def below(pct: Column, norm: tuple[int, int]) -> Column:
        return pct < norm[0] - norm[1]

    def above(pct: Column, norm: tuple[int, int]) -> Column:
        return pct > norm[0] + norm[1]

    short = below(housing, HOUSING_NORM) | below(transport, TRANSPORT_NORM)
    over = above(housing, HOUSING_NORM) | above(transport, TRANSPORT_NORM)
    verdict = (
        F.when(short, "worse_than_default").when(over, "better_than_law").otherwise("compliant")
    )
    position = F.when(short, "below").when(over, "above").otherwise("in line with")
    text = F.concat(
        F.lit("Housing is "), short_number(housing),
        F.lit(f"% of the basic wage (market norm about {HOUSING_NORM[0]}%) and transport is "),
        short_number(transport), F.lit(f"% (about {TRANSPORT_NORM[0]}%)."),
    )
    value = F.concat(short_number(housing), F.lit("% / "), short_number(transport), F.lit("%"))
    return F.when(basic > 0, _outcome(verdict, text, position=position, value=value))


FIELD_CHECKS: dict[str, Check] = {
    "PROB-MAX-01": check_probation_length,
    "PROB-EXCL-01": check_probation_exclusions,
    "LEAVE-MIN-01": check_annual_leave,
    "HOURS-MAX-01": check_working_hours,
    "OT-RATE-01": check_overtime_premium,
    "MARKET-ALLOW-01": check_allowances,
}

# Info rules not listed here always apply. An unknown probation still counts as one.
INFO_CONDITIONS: dict[str, Condition] = {
    "PROB-NOCOMP-01": lambda: ~F.col("probation_days").eqNullSafe(F.lit(0)),
    "RENEW-CONVERT-01": lambda: F.col("contract_type").eqNullSafe("fixed_term")
    & F.col("nationality").eqNullSafe("saudi"),
    "NOTICE-INDEF-01": lambda: F.col("contract_type").eqNullSafe("indefinite"),
    "SETTLE-TIME-01": lambda: F.lit(True),
}


def field_outcomes(
    fields: DataFrame, rules: RuleSet, checks: Mapping[str, Check] = FIELD_CHECKS
) -> DataFrame:
    """``contract_id, rule_id, outcome``: every rule that has a check, where it applies."""
    ids = [r["id"] for r in rules.of_kind("field", "market") if r["id"] in checks]
    pairs = [
        F.struct(F.lit(i).alias("rule_id"), checks[i]().cast(OUTCOME_TYPE).alias("outcome"))
        for i in ids
    ]
    return fields.select("contract_id", F.inline(F.array(*pairs))).where("outcome IS NOT NULL")


def field_findings(
    fields: DataFrame,
    rules: RuleSet,
    checks: Mapping[str, Check] = FIELD_CHECKS,
    conditions: Mapping[str, Condition] = INFO_CONDITIONS,
) -> DataFrame:
    """Field, market and info findings. A map-only plan: the rule table is broadcast."""
    no_values = F.create_map().cast(VALUES_TYPE)
    entries = []
    for r in rules.rules:
        rule_id = r["id"]
        if r["kind"] in ("field", "market") and rule_id in checks:
            entries.append((rule_id, checks[rule_id]().cast(OUTCOME_TYPE)))
        elif r["kind"] == "info":
            applies = conditions.get(rule_id, lambda: F.lit(True))()
            entries.append(
                (
                    rule_id,
                    F.when(
                        applies,
                        F.struct(
                            F.lit("compliant").alias("verdict"),
                            F.lit(r["title"]).alias("explanation"),
                            no_values.alias("values"),
                        ),
                    ).cast(OUTCOME_TYPE),
                )
            )
    pairs = [F.struct(F.lit(i).alias("rule_id"), o.alias("outcome")) for i, o in entries]
    rows = fields.select("contract_id", F.inline(F.array(*pairs))).where("outcome IS NOT NULL")
    rule = rules.packed(fields.sparkSession)
    verdict = F.col("outcome.verdict")
    clause = F.lit(None).cast("string")
    for rule_id, number in TEMPLATE_CLAUSE.items():
        clause = F.when(F.col("rule_id") == rule_id, number).otherwise(clause)
    joined = rows.join(rule, F.col("rule_id") == F.col("rule.id"))
    return joined.select(
        "contract_id",
        F.lit(0).alias("step"),
        F.col("rule.rule_order").cast("bigint").alias("step_order"),
        "rule_id",
        clause.alias("clause"),
        F.lit(None).cast("string").alias("related_clause"),
        verdict.alias("verdict"),
        F.when(is_problem(verdict), F.col("rule.severity_if_fail"))
        .otherwise("none")
        .alias("severity"),
        F.col("rule.confidence").alias("confidence"),
        F.col("rule.categories").alias("categories"),
        F.col("rule.articles").alias("articles"),
        F.col("outcome.explanation").alias("explanation"),
        *finding_texts(verdict, F.col("outcome.values")),
        F.when(F.col("rule.kind") == "info", "info")
        .when(F.col("rule.kind") == "market", "market")
        .otherwise("field_rule")
        .alias("source"),
        F.lit(False).alias("needs_review"),
        F.col("rule.impact").alias("impact_kind"),
        F.lit(None).cast(PARAMS_TYPE).alias("impact_params"),
    )


PARAMS_TYPE = (
    "struct<eos_base:string,compensation_months:double,compensation_base:string,"
    "non_compete_months:double>"
)


# --- deadlines ---------------------------------------------------------------------------


def renewal_notice_date(today: Column) -> Column:
    """Notice is due ``renewal_notice_days`` before the end date, rolled forward by terms.

    The number of terms is found from the month distance and settled by its neighbours, and
    months are always counted from the original end date, so month ends do not drift.
    """
    end, notice = F.col("end_date"), F.col("renewal_notice_days")
    term = term_months(F.col("term_months"), F.col("commencement_date"), end)
    first = F.date_sub(end, notice)

    def after(terms: Column) -> Column:
        return F.date_sub(F.add_months(end, (terms * term).cast("int")), notice)

    # At least this many whole terms lie between the end and the day notice must reach.
    gap = F.months_between(F.date_add(today, notice), end)
    low = F.greatest(F.lit(1), F.floor(gap / term).cast("int") - 1)
    candidates = [F.least(low + i, F.lit(MAX_TERMS_TO_ROLL)) for i in range(4)]
    rolled = F.coalesce(*[F.when(after(n) >= today, after(n)) for n in candidates])
    date = F.when(first >= today, first).when(
        F.col("auto_renew") & term.isNotNull() & (term > 0), rolled
    )
    return F.when(~F.col("auto_renew").eqNullSafe(F.lit(False)), date)


def probation_end_date(today: Column) -> Column:
    days = F.col("probation_days")
    date = F.date_add(
        F.col("commencement_date"), F.least(days, F.lit(PROBATION_MAX_DAYS)).cast("int") - 1
    )
    return F.when((days > 0) & (date >= today), date)


DEADLINE_CHECKS: dict[str, tuple[str, DeadlineCheck]] = {
    "RENEW-DEADLINE-01": ("renewal_notice", renewal_notice_date),
    "PROB-NOCOMP-01": ("probation_end", probation_end_date),
}


def deadlines(
    fields: DataFrame,
    rules: RuleSet,
    today: str,
    checks: Mapping[str, tuple[str, DeadlineCheck]] = DEADLINE_CHECKS,
) -> DataFrame:
    """One row per deadline still ahead, numbered by date within the contract."""
    day = F.lit(today).cast("date")
    entries = []
    for order, rule in enumerate(rules.rules):
        if rule["id"] not in checks:
            continue
        kind, check = checks[rule["id"]]
        own = (rule["employeeMsg"], rule["hrMsg"])
        employee, hr = PROBATION_END_MSG if kind == "probation_end" else own
        entries.append(
            F.struct(
                check(day).alias("date"),
                F.lit(order).alias("rule_order"),
                F.lit(rule["id"]).alias("rule_id"),
                F.lit(kind).alias("kind"),
                F.lit(employee).alias("employee_msg"),
                F.lit(hr).alias("hr_msg"),
            )
        )
    ahead = F.filter(F.array(*entries), lambda d: d["date"].isNotNull())
    # At most one entry per deadline rule, so the sort is within the row: no shuffle.
    rows = fields.select("contract_id", F.posexplode(F.sort_array(ahead)).alias("n", "d"))
    values = F.create_map(F.lit("deadline"), F.col("d.date").cast("string"))
    return rows.select(
        "contract_id",
        (F.col("n") + 1).alias("deadline_no"),
        F.col("d.rule_id").alias("rule_id"),
        F.col("d.date").alias("date"),
        F.col("d.kind").alias("kind"),
        fill(F.col("d.employee_msg"), values).alias("employee_msg"),
        fill(F.col("d.hr_msg"), values).alias("hr_msg"),
    )


# --- summary -----------------------------------------------------------------------------

TYPE_LABEL = {
    "fixed_term": "fixed-term",
    "indefinite": "indefinite (open-ended)",
    "specific_work": "for a specific work",
}
NOT_FOUND = "not found"


def field_summary() -> Column:
    """One paragraph of contract terms; no names, ids, nationality, job or place."""

    def text(value: Column, unit: str = "") -> Column:
        return F.coalesce(F.concat(value, F.lit(unit)), F.lit(NOT_FOUND))

    def number(name: str, unit: str = "") -> Column:
        return text(short_number(F.col(name)), unit)

    label = F.lit(NOT_FOUND)
    for name, words in TYPE_LABEL.items():
        label = F.when(F.col("contract_type") == name, words).otherwise(label)
    renews = F.when(F.col("auto_renew"), "yes").when(~F.col("auto_renew"), "no")
    w = lambda part: thousands(F.col(f"wage.{part}").cast("double"))
    wage = F.concat(
        F.lit("Monthly wage (SAR): basic "), w("basic"), F.lit(", housing "), w("housing"),
        F.lit(", transport "), w("transport"), F.lit(", other allowances "), w("other"),
        F.lit(", total "), w("total"), F.lit("."),
    )
    parts = [
        ("Contract type: ", label),
        ("Start date: ", text(F.col("commencement_date").cast("string"))),
        ("End date: ", text(F.col("end_date").cast("string"))),
        ("Term: ", number("term_months", " months")),
        ("Renews automatically: ", F.coalesce(renews, F.lit(NOT_FOUND))),
        ("Non-renewal notice: ", number("renewal_notice_days", " days before the end date")),
        ("Probation: ", number("probation_days", " days")),
        ("Working days per week: ", number("work_days_per_week")),
        ("Daily hours: ", number("daily_hours")),
        ("Weekly hours: ", number("weekly_hours")),
        ("Rest days per week: ", number("rest_days_per_week")),
        ("Annual leave: ", number("annual_leave_days", " days a year")),
    ]
    sentences = [F.concat(F.lit(name), value, F.lit(".")) for name, value in parts]
    sentences.append(F.coalesce(wage, F.lit(f"Monthly wage: {NOT_FOUND}.")))
    overtime = number("overtime_premium_pct", "% of the basic hourly wage")
    sentences.append(F.concat(F.lit("Overtime premium: "), overtime, F.lit(".")))
    return F.concat_ws(" ", *sentences)
