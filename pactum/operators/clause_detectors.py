"""One detector per rule over a clause's text, as column expressions.

``read_clauses`` prepares the columns a detector reads: ``text`` (normalised English or the
gloss of the Arabic), ``sentences``, ``spans`` (every quantity with its sentence and the words
around it) and ``probation_days``. A detector
returns a nullable struct of ``DETECTION_TYPE``. The whole scan is map-only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.numbers import one_decimal
from pactum.functions.quantities import (
    first_months,
    is_marked,
    let,
    mark_quantities,
    marked_quantities,
    percentages,
    quantities,
    to_days,
    unmark,
)
from pactum.functions.text import (
    FOREIGN,
    collapse,
    gloss_form,
    gloss_form_text,
    nfkc,
    normalise_english,
    split_sentences,
)
from pactum.operators import clause_patterns as p
from pactum.operators.glossary import GLOSSARY
from pactum.operators.rule_table import RuleSet

Detector = Callable[[], Column]

PARAMS_TYPE = (
    "struct<eos_base:string,compensation_months:double,compensation_base:string,"
    "non_compete_months:double>"
)
DETECTION_TYPE = (
    "struct<verdict:string,severity:string,confidence:string,explanation:string,"
    f"params:{PARAMS_TYPE}>"
)
MATCH_TYPE = (
    "struct<rule_id:string,verdict:string,severity:string,confidence:string,"
    f"articles:array<string>,explanation:string,params:{PARAMS_TYPE}>"
)

# Limits.
PROBATION_LIMIT_DAYS = 180
MIN_LEAVE_DAYS, MIN_LEAVE_DAYS_AFTER_FIVE_YEARS = 21, 30
NORMAL_HOURS, RAMADAN_HOURS = (8, 48), (6, 36)
NONCOMPETE_LIMIT_MONTHS = 24
LEGAL_PREMIUM = 50


def gloss_arabic(text: Column, with_nfkc: bool = True) -> Column:
    """A rough English reading of Arabic, phrase by phrase, longest phrase first."""
    entries = []
    for arabic, english in GLOSSARY:
        key = gloss_form_text(arabic)
        key = (" " if arabic.startswith(" ") else "") + key + (" " if arabic.endswith(" ") else "")
        entries.append((key, f" {english} "))
    entries.sort(key=lambda e: -len(e[0]))
    quoted = [tuple(x.replace("\\", "\\\\").replace("'", "\\'") for x in e) for e in entries]
    table = F.expr("array(" + ", ".join(f"struct('{a}' AS ar, '{e}' AS en)" for a, e in quoted) + ")")
    start = F.concat(F.lit(" "), gloss_form(text, with_nfkc), F.lit(" "))
    glossed = F.aggregate(table, start, lambda t, e: F.replace(t, e["ar"], e["en"]))
    return glossed


def read_clauses(clauses: DataFrame) -> DataFrame:
    """Adds the columns detectors read; clauses with no text at all are dropped."""
    en, ar = F.coalesce("text_en", F.lit("")), F.coalesce("text_ar", F.lit(""))
    # The test for text uses the raw columns, so it can be pushed to the scan.
    df = clauses.where((F.trim(en) != "") | (F.trim(ar) != "")).withColumn(
        "max_confidence", F.when(collapse(en) != "", "high").otherwise("medium")
    )
    english = F.col("max_confidence") == "high"
    df = df.withColumn("_raw", nfkc(F.when(english, en).otherwise(F.trim(ar))))
    # Only Arabic-only clauses are glossed.
    source = F.when(english, F.col("_raw")).otherwise(gloss_arabic(F.col("_raw"), with_nfkc=False))
    df = df.withColumn("_text", source).withColumn(
        "_text", normalise_english(F.col("_text"), with_nfkc=False)
    )
    # Patterns are ASCII: any other character is masked by a sign that is no letter, so word
    # boundaries mean ASCII words.
    df = df.withColumn("text", F.regexp_replace("_text", FOREIGN, "¤")).drop("_raw", "_text")
    if "probation_days" not in df.columns:
        df = df.withColumn("probation_days", F.lit(None).cast("int"))
    # Quantities are marked once in the text; a mark never crosses a sentence end.
    df = df.withColumn("_marked", split_sentences(mark_quantities(F.col("text"))))
    spans = F.flatten(
        F.transform(
            F.filter("_marked", is_marked),
            lambda m: F.transform(
                marked_quantities(m),
                lambda q: F.struct(
                    unmark(m).alias("sentence"),
                    q["value"].alias("value"),
                    q["unit"].alias("unit"),
                    q["before"].alias("before"),
                    q["after"].alias("after"),
                ),
            ),
        )
    )
    return df.withColumns({"sentences": F.transform("_marked", unmark), "spans": spans}).drop("_marked")


def has(pattern: str, column: str = "text") -> Column:
    return F.col(column).rlike(pattern)


def detection(
    verdict: str | Column,
    severity: str | Column,
    confidence: str | Column,
    explanation: str | Column,
    **params: Column,
) -> Column:
    def c(x: str | Column) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    fixed = (verdict, severity, confidence, explanation)
    if not params and all(isinstance(x, str) for x in fixed):
        # One call into the JVM for a constant.
        quoted = ["'" + x.replace("'", "\\'") + "'" for x in fixed]
        return F.expr(f"CAST(struct({', '.join(quoted)}, CAST(NULL AS {PARAMS_TYPE})) AS {DETECTION_TYPE})")
    names = "eos_base compensation_months compensation_base non_compete_months".split()
    pack = F.struct(
        *[(params[n] if n in params else F.lit(None)).alias(n) for n in names]
    ).cast(PARAMS_TYPE)
    return F.struct(
        c(verdict).alias("verdict"),
        c(severity).alias("severity"),
        c(confidence).alias("confidence"),
        c(explanation).alias("explanation"),
        (pack if params else F.lit(None).cast(PARAMS_TYPE)).alias("params"),
    ).cast(DETECTION_TYPE)


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _num(x: Column) -> Column:
    return one_decimal(x)


def detect_probation() -> Column:
    def count(s: Column) -> Column:
        before, after = s["before"], s["after"]
        extended = before.rlike(p.EXTENSION)
        kind = (
            F.when(before.rlike(p.ADDED_BEFORE), "added")
            .when(before.rlike(p.TOTAL_BEFORE) | after.rlike(p.TOTAL_AFTER), "total")
            .when(extended & before.rlike(p.BY_OR_FOR_BEFORE), "added")
            .when(before.rlike(p.LIMIT_BEFORE), "total")
            .when(extended, "added")
            .otherwise("length")
        )
        skipped = before.rlike(p.NOTICE_BEFORE) | after.rlike(p.DEADLINE_AFTER)
        days = F.when(~skipped, to_days(s))
        return F.struct(days.alias("days"), kind.alias("kind"))

    counts = F.filter(F.transform("spans", count), lambda c: c["days"].isNotNull())
    return F.when(
        has(p.PROBATION), let(let(counts, _probation_total), _probation_verdict)
    )


def _probation_total(counts: Column) -> Column:
    """A stated total wins; else the length (or the recorded one) plus what is added."""

    def of(kind: str) -> Column:
        return F.transform(F.filter(counts, lambda c: c["kind"] == kind), lambda c: c["days"])

    zero = F.lit(0.0)
    total, length = F.array_max(of("total")), F.try_element_at(of("length"), F.lit(1))
    added = F.aggregate(of("added"), zero, lambda a, d: a + d)
    base = F.coalesce(length, F.col("probation_days").cast("double"))
    return (
        F.when(total.isNotNull(), total)
        .when(added > 0, F.coalesce(base, zero) + added)
        .when(base.isNotNull() & has(p.SERVED_TWICE), base * 2)
        .otherwise(length)
    )


def _probation_verdict(days: Column) -> Column:
    says = lambda tail: _say("Probation comes to ", _num(days), f" days, {tail}.")
    limit = PROBATION_LIMIT_DAYS
    return (
        F.when(days > limit, detection("likely_void", "high", "high", says(f"over the {limit} the law permits")))
        .when(days == limit, detection("compliant", "none", "high", says("the legal maximum")))
        .when(days < limit, detection("better_than_law", "none", "high", says(f"under the {limit} the law permits")))
    )


def detect_leave_minimum() -> Column:
    kept = F.filter(
        "spans",
        lambda s: s["unit"].isin("day", "week")
        & ~s["sentence"].rlike(p.CARRY_FORWARD)
        & ~F.substring(s["after"], 1, 20).rlike(p.DEADLINE_AFTER),
    )
    topic = has(p.ANNUAL_LEAVE) & ~(has(p.OTHER_LEAVE) & ~has(r"\bannual\b"))
    return F.when(topic, let(F.transform(kept, to_days), _leave_verdict))


def _leave_verdict(days: Column) -> Column:
    base = F.try_element_at(days, F.lit(1))
    later = F.when(has(p.AFTER_FIVE_YEARS), F.try_element_at(days, F.lit(2)))
    low = F.when(base < MIN_LEAVE_DAYS, base).when(later < MIN_LEAVE_DAYS_AFTER_FIVE_YEARS, later)
    return (
        F.when(
            low.isNotNull(),
            detection(
                "likely_void", "high", "high",
                _say("The clause grants ", _num(low), " days of leave; the law asks for 21, then 30 after five years."),
            ),
        )
        .when(
            base == MIN_LEAVE_DAYS,
            detection("compliant", "none", "high", "The clause grants the legal minimum of 21 days of leave."),
        )
        .when(
            base > MIN_LEAVE_DAYS,
            detection("better_than_law", "none", "high", _say("The clause grants ", _num(base), " days of leave, over the minimum of 21.")),
        )
    )


def detect_leave_forfeiture() -> Column:
    return F.when(
        has(p.LEAVE_TOPIC),
        F.when(
            has(p.FORFEITED),
            detection("likely_void", "medium", "high", "Untaken leave lapses or goes unpaid; the law requires payment and voids a waiver."),
        )
        .when(
            has(p.NO_CARRY_FORWARD) & has(p.PAID_OUT),
            detection("compliant", "none", "medium", "Leave is not carried forward but untaken days are paid."),
        )
        .when(
            has(p.NO_CARRY_FORWARD),
            detection("unclear", "low", "high", "Leave must be used within the year; untaken days must still be paid."),
        ),
    )


def detect_working_hours() -> Column:
    ramadan = has(p.RAMADAN)
    daily_limit = F.when(ramadan, RAMADAN_HOURS[0]).otherwise(NORMAL_HOURS[0])
    weekly_limit = F.when(ramadan, RAMADAN_HOURS[1]).otherwise(NORMAL_HOURS[1])

    def stated(s: Column) -> Column:
        after, before = F.substring(s["after"], 1, 30), F.right(s["before"], F.lit(40))
        period = (
            F.when(after.rlike(p.DAY_AFTER), "day")
            .when(after.rlike(p.WEEK_AFTER), "week")
            .when(before.rlike(p.DAY_BEFORE), "day")
            .when(before.rlike(p.WEEK_BEFORE), "week")
        )
        # Figures after the first overtime word of the sentence are not normal hours.
        overtime_first = F.regexp_instr(s["sentence"], F.lit(p.OVERTIME_WORDS))
        normal = (overtime_first == 0) | (F.length(s["before"]) + 1 < overtime_first)
        limit = F.when(period == "day", daily_limit).otherwise(weekly_limit)
        return F.struct(
            F.when((s["unit"] == "hour") & normal & period.isNotNull(), s["value"]).alias("value"),
            period.alias("period"),
            limit.alias("limit"),
        )

    hours = F.filter(F.transform("spans", stated), lambda h: h["value"].isNotNull())
    return F.when(
        has(p.HOURS_TOPIC), let(hours, lambda h: _hours_verdict(h, daily_limit, weekly_limit))
    )


def _hours_verdict(hours: Column, daily_limit: Column, weekly_limit: Column) -> Column:
    over = F.try_element_at(F.filter(hours, lambda h: h["value"] > h["limit"]), F.lit(1))
    verdict = (
        F.when(F.size(hours) == 0, F.lit(None).cast(DETECTION_TYPE))
        .when(
            over.isNotNull(),
            detection(
                "likely_void", "high", "high",
                _say("Normal hours are ", _num(over["value"]), " a ", over["period"], "; the law caps them at ",
                     daily_limit.cast("string"), " a day and ", weekly_limit.cast("string"), " a week."),
            ),
        )
        .when(
            F.forall(hours, lambda h: h["value"] == h["limit"]),
            detection("compliant", "none", "high", "Working hours are set at the legal maximum."),
        )
        .otherwise(detection("better_than_law", "none", "high", "Working hours are set below the legal maximum."))
    )
    return verdict


def detect_eos_base() -> Column:
    text = F.regexp_replace("text", p.RULED_OUT_WAGE, " ")
    text = F.regexp_replace(text, p.BASIC_AS_PART_OF_FULL_WAGE, "$1")
    base = let(text, _eos_base)
    return F.when(has(p.END_OF_SERVICE), let(base, _eos_verdict))


def _eos_base(text: Column) -> Column:
    return (
        F.when(text.rlike(p.BASIC_PLUS_ALL_ALLOWANCES), "actual")
        .when(text.rlike(p.BASIC_HOUSING_AND_TRANSPORT), "standard")
        .when(text.rlike(p.BASIC_PLUS_ONE_ALLOWANCE), "other")
        .when(text.rlike(p.BASIC_WAGE), "basic")
        .when(text.rlike(p.EXCLUDING_ALLOWANCES), "basic")
        .when(text.rlike(p.ACTUAL_WAGE), "actual")
    )


def _eos_verdict(base: Column) -> Column:
    return (
        F.when(base == "basic", detection("likely_void", "high", "high", "The award is based on basic salary only; the law uses the last actual wage.", eos_base=F.lit("basic")))
        .when(base == "other", detection("likely_void", "high", "medium", "The award leaves out some allowances; the law uses the last actual wage.", eos_base=F.lit("other")))
        .when(base == "actual", detection("compliant", "none", "high", "The award is based on the last actual wage.", eos_base=F.lit("actual")))
        .when(base == "standard", detection("compliant", "none", "medium", "The award uses basic, housing and transport, the whole wage of a standard contract.", eos_base=F.lit("actual")))
        .when(has(p.LAW_REFERENCE), detection("compliant", "none", "medium", "The award is left to the Labor Law."))
    )


def detect_art77() -> Column:
    at = F.regexp_instr(F.col("text"), F.lit(p.COMPENSATION))
    rest = F.substring(F.col("text"), at, F.length("text"))
    topic = (at > 0) & has(p.ENDING_CONTRACT) & has(p.WITHOUT_VALID_REASON)
    return F.when(
        topic,
        let(rest, lambda r: let(first_months(quantities(r), weeks=False), lambda m: _art77_verdict(r, m))),
    )


def _art77_verdict(rest: Column, months: Column) -> Column:
    base = F.when(rest.rlike(p.BASIC_WAGE), "basic").otherwise("actual")
    return (
        F.when(rest.rlike(p.REST_OF_TERM), detection("compliant", "none", "medium", "The clause pays the wages for the rest of the term."))
        .when(
            months.isNotNull(),
            detection(
                "worse_than_default", "medium", "high",
                _say("Compensation is fixed at ", _num(months), " month(s) of ", base, " wage; the default is usually more."),
                compensation_months=months, compensation_base=base,
            ),
        )
        .when(rest.rlike(p.FIXED_SUM), detection("worse_than_default", "medium", "medium", "Compensation is fixed at a set sum; the default is usually more."))
        .when(has(p.LAW_REFERENCE), detection("compliant", "none", "medium", "Compensation is left to the Labor Law."))
    )


def detect_overtime() -> Column:
    percent = F.try_element_at(percentages(F.col("text")), F.lit(1))
    return F.when(has(p.OVERTIME), let(percent, _overtime_verdict))


def _overtime_verdict(percent: Column) -> Column:
    premium = F.when(percent > 100, percent - 100).otherwise(percent)
    sure = F.when(
        (percent > 100) | (percent < LEGAL_PREMIUM) | has(p.SAYS_PLUS), "high"
    ).otherwise("medium")
    stated = _say("Overtime pays a premium of ", _num(premium), "%; the minimum is 50%.")
    by_premium = (
        F.when(premium < LEGAL_PREMIUM, detection("likely_void", "high", sure, stated))
        .when(premium == LEGAL_PREMIUM, detection("compliant", "none", sure, stated))
        .otherwise(detection("better_than_law", "none", sure, stated))
    )
    return (
        F.when(
            has(p.TIME_OFF_INSTEAD),
            F.when(has(p.WORKER_CONSENT), detection("compliant", "none", "medium", "Time off replaces overtime pay only with the worker's consent."))
            .otherwise(detection("likely_void", "high", "high", "Time off replaces overtime pay without the worker's consent.")),
        )
        .when(has(p.NOT_PAID), detection("likely_void", "high", "high", "Overtime is unpaid or counted as covered by the salary."))
        .when(percent.isNotNull(), by_premium)
        .when(has(p.TIME_AND_A_HALF), detection("compliant", "none", "high", "Overtime is paid at time and a half or more."))
        .when(has(p.LAW_REFERENCE) | has(p.ARTICLE_107), detection("compliant", "none", "medium", "Overtime is paid as the Labor Law requires."))
        .when(has(p.PAY_UNDECIDED), detection("unclear", "medium", "high", "Overtime pay is left to the employer's policy or discretion."))
        .when(has(p.REQUIRED_WHEN_NEEDED), detection("unclear", "medium", "high", "Extra hours are required without saying they are paid as overtime."))
    )


# Order of the stated types in results.
STATED_TYPES = {"specific_work": p.PROJECT_END, "indefinite": p.INDEFINITE, "fixed_term": p.FIXED_TERM}


def stated_types() -> Column:
    """Contract types a clause states for the contract as a whole."""

    def about_contract(s: Column) -> Column:
        contract = F.regexp_instr(s, F.lit(p.CONTRACT_WORD))
        pay = F.regexp_instr(s, F.lit(p.PAY_WORD))
        return (contract > 0) & ((pay == 0) | (contract < pay)) & ~s.rlike(p.ABOUT_OTHER_DUTY)

    def states(kept: Column, pattern: str) -> Column:
        return F.exists(kept, lambda s: s.rlike(pattern))

    return let(
        F.filter("sentences", about_contract),
        lambda kept: F.array_compact(
            F.array(*[F.when(states(kept, x), name) for name, x in STATED_TYPES.items()])
        ),
    )


def detect_project_end() -> Column:
    verdict = F.when(
        has(p.WORK_DEFINED),
        detection("compliant", "none", "medium", "The contract ends with a piece of work that the clause defines."),
    ).otherwise(
        detection("unclear", "high", "high", "The contract ends with a project the clause does not define, so the end is uncertain.")
    )
    return F.when(F.array_contains("stated", "specific_work"), verdict)


def detect_transfer() -> Column:
    verdict = F.when(
        has(p.WORKER_CONSENT),
        detection("compliant", "none", "medium", "A transfer needs the worker's agreement at the time."),
    ).otherwise(
        detection("worse_than_default", "medium", "high", "The worker can be moved anywhere in the Kingdom; this counts as consent to relocation.")
    )
    return F.when(has(p.TRANSFER) & has(p.ANY_PLACE) & ~has(p.SAME_CITY_ONLY), verdict)


def detect_noncompete() -> Column:
    topic = has(p.COMPETITION) & has(p.AFTER_CONTRACT_ENDS)
    return F.when(topic, let(first_months(F.col("spans")), _noncompete_gaps))


def _noncompete_gaps(months: Column) -> Column:
    too_long = months > NONCOMPETE_LIMIT_MONTHS
    place = has(p.SAUDI_PLACE) & ~has(p.UNLIMITED_PLACE)
    work = has(p.LIMITED_WORK) & ~has(p.UNLIMITED_WORK)
    gaps = F.array_compact(
        F.array(
            F.when(months.isNull(), "no duration"),
            F.when(too_long, _say("a duration of ", _num(months), " months, over two years")),
            F.when(~place, "no limit on place"),
            F.when(~work, "no limit on the type of work"),
            F.when(~has(p.CLIENT_ACCESS), "no tie to access to clients"),
        )
    )
    return let(gaps, lambda g: _noncompete_verdict(months, too_long, g))


def _noncompete_verdict(months: Column, too_long: Column, gaps: Column) -> Column:
    void = F.coalesce(too_long, F.lit(False)) | (F.size(gaps) >= 3)
    return F.when(
        F.size(gaps) == 0,
        detection("compliant", "none", "high", _say("The non-compete lasts ", _num(months), " months and is limited as the law requires."), non_compete_months=months),
    ).otherwise(
        detection(
            "likely_void", "high", F.when(void, "high").otherwise("medium"),
            _say("The non-compete has ", F.array_join(gaps, ", "), "; the law asks for limits in time, place and work."),
            non_compete_months=months,
        )
    )


def detect_confidentiality() -> Column:
    secrecy = has(p.NO_SHARING) | has(p.KEEP_SECRET)
    after, unlimited = has(p.AFTER_CONTRACT_ENDS), has(p.WITHOUT_TIME_LIMIT)
    months = first_months(F.col("spans"))
    silent = secrecy & has(p.WORKER_BOUND) & ~has(p.DURING_EMPLOYMENT_ONLY) & months.isNull()
    verdict = (
        F.when(
            ~after & ~unlimited,
            F.when(silent, detection("unclear", "low", "medium", "The secrecy duty states no time limit, so it may run on after the contract.")),
        )
        .when(
            after & months.isNotNull() & ~unlimited,
            detection("compliant", "none", "medium", _say("Secrecy lasts ", _num(months), " months after the contract, a stated limit.")),
        )
        .otherwise(detection("unclear", "low", "high", "Secrecy continues after the contract with no limit on time or kind."))
    )
    return F.when(has(p.CONFIDENTIALITY) | secrecy, verdict)


CLAUSE_DETECTORS: dict[str, Detector] = {
    "PROB-MAX-01": detect_probation,
    "LEAVE-MIN-01": detect_leave_minimum,
    "LEAVE-FORFEIT-01": detect_leave_forfeiture,
    "HOURS-MAX-01": detect_working_hours,
    "OT-RATE-01": detect_overtime,
    "EOS-BASE-01": detect_eos_base,
    "COMP-ART77-01": detect_art77,
    "TYPE-ART57-01": detect_project_end,
    "TRANSFER-KSA-01": detect_transfer,
    "NONCOMPETE-01": detect_noncompete,
    "CONFIDENTIAL-01": detect_confidentiality,
}


DETECTORS_PER_STEP = 3


#: What a clause's reading and detections depend on.
INPUTS = ("text_en", "text_ar", "probation_days")


def once_per_text(clauses: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The clauses with the columns that ``analyse`` adds to rows of INPUTS, each distinct row of them analysed once.

    Standard wordings stand in very many contracts: equal inputs are combined before the shuffle, so a text that a third
    of all clauses share is one row for each task, and what it gave is joined back by a 128-bit key of the inputs. The
    clauses are that join's streamed side, so the adaptive skew join splits a frequent text.
    """
    inputs = [c for c in INPUTS if c in clauses.columns]
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in inputs]
    keyed = clauses.withColumn("_key", F.md5(F.concat_ws("\x1f", *marked)))
    found = analyse(keyed.select("_key", *inputs).distinct())
    return keyed.join(found.drop(*inputs), "_key").drop("_key")


def analyse_clauses(
    clauses: DataFrame, rules: RuleSet, detectors: Mapping[str, Detector] = CLAUSE_DETECTORS
) -> DataFrame:
    """Adds ``text``, ``max_confidence``, ``stated`` and ``matches``: one per candidate rule the clause touches, in rule order.

    ``clauses`` holds ``text_en, text_ar`` and, where known, ``probation_days``; equal ones are analysed once.
    """
    return once_per_text(clauses, lambda texts: _detected(texts, rules, detectors))


def state_types(clauses: DataFrame) -> DataFrame:
    """Adds ``text``, ``max_confidence`` and ``stated``, all that the cross-check of the contract type reads."""
    return once_per_text(clauses, lambda texts: read_clauses(texts).select(
        *texts.columns, "text", "max_confidence", stated_types().alias("stated")
    ))


def _detected(
    clauses: DataFrame, rules: RuleSet, detectors: Mapping[str, Detector] = CLAUSE_DETECTORS
) -> DataFrame:
    keep = clauses.columns
    read = read_clauses(clauses).withColumn("stated", stated_types())
    matches = []
    for rule in rules.candidates().rules:
        if rule["id"] not in detectors:
            continue
        found = detectors[rule["id"]]()
        articles = F.array(*[F.lit(a) for a in rule["articles"]]).cast("array<string>")
        matches.append((rule["id"], found, articles))
    # Detections become columns first, so each is computed once per clause. A few at a time,
    # each group in its own operator: one projection of all would be too large a method to be
    # compiled well.
    for start in range(0, len(matches), DETECTORS_PER_STEP):
        group = matches[start : start + DETECTORS_PER_STEP]
        step = F.struct(*[m[1].alias(f"_d{start + i}") for i, m in enumerate(group)])
        read = read.select("*", F.inline(F.array(step)))
    packed = []
    for i, (rule_id, _, articles) in enumerate(matches):
        d = F.col(f"_d{i}")
        confidence = F.when(
            (F.col("max_confidence") == "medium") & (d["confidence"] == "high"), "medium"
        ).otherwise(d["confidence"])
        packed.append(
            F.when(
                d.isNotNull(),
                F.struct(
                    F.lit(rule_id).alias("rule_id"),
                    d["verdict"].alias("verdict"),
                    d["severity"].alias("severity"),
                    confidence.alias("confidence"),
                    articles.alias("articles"),
                    d["explanation"].alias("explanation"),
                    d["params"].alias("params"),
                ),
            ).cast(MATCH_TYPE)
        )
    return read.select(
        *keep, "text", "max_confidence", "stated",
        F.array_compact(F.array(*packed)).alias("matches"),
    )


# --- cross-check of the contract type ------------------------------------------------------

# Fixed values.
CONTRADICTS = {
    "fixed_term": ["indefinite", "specific_work"],
    "indefinite": ["fixed_term", "specific_work"],
    "specific_work": ["indefinite", "fixed_term"],
}
CLAUSE_SAYS = {
    "fixed_term": "it runs for a fixed term",
    "indefinite": "it runs for an unlimited period",
    "specific_work": "it ends when a project or specific work is completed",
}
RECORDED_AS = {
    "fixed_term": "a fixed-term contract",
    "indefinite": "an indefinite (open-ended) contract",
    "specific_work": "a contract for a specific work",
}


def recorded_type(summary: Column) -> Column:
    """The contract type a field summary names."""
    value = F.lower(F.regexp_extract(summary, r"(?i)contract type:\s*([^.]*)", 1))
    return (
        F.when(value.rlike(p.RECORDED_INDEFINITE), "indefinite")
        .when(value.rlike(p.RECORDED_FIXED), "fixed_term")
        .when(value.rlike(p.RECORDED_WORK), "specific_work")
    )


def _lookup(key: Column, table: Mapping[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def type_conflicts(analysed: DataFrame, rules: RuleSet, recorded: Column) -> DataFrame:
    """Clauses that state another contract type than the recorded one."""
    rule = next((r for r in rules.of_kind("cross") if r["id"] == "TYPE-CONFLICT-01"), None)
    if rule is None:
        return analysed.where("false").withColumns(
            {"rule_id": F.lit(None).cast("string"), "template_clause": F.lit(None).cast("string")}
        )
    lists = {
        k: F.array(*[F.lit(x) for x in v]) for k, v in CONTRADICTS.items()
    }
    df = analysed.withColumn("recorded", recorded)
    df = df.withColumn("conflicting", F.array_intersect(_lookup(F.col("recorded"), lists), "stated"))
    only_project = (F.size("conflicting") == 1) & (F.col("conflicting")[0] == "specific_work")
    template = F.when(only_project & (F.col("recorded") == "fixed_term"), "5.1").otherwise("1")
    says = F.array_join(
        F.transform("conflicting", lambda t: _lookup(t, {k: F.lit(v) for k, v in CLAUSE_SAYS.items()})),
        " and ",
    )
    as_recorded = _lookup(F.col("recorded"), {k: F.lit(v) for k, v in RECORDED_AS.items()})
    conflict = F.when(
        F.size("conflicting") > 0,
        F.struct(
            F.lit(rule["id"]).alias("rule_id"),
            template.alias("template_clause"),
            F.lit("high").alias("severity"),
            F.col("max_confidence").alias("confidence"),
            F.array(*[F.lit(a) for a in rule["articles"]]).cast("array<string>").alias("articles"),
            _say("The contract is recorded as ", as_recorded, ", but this clause says ", says,
                 "; the recorded type most likely prevails.").alias("explanation"),
        ),
    )
    # The filter sits on the generated row: on the expression itself it would be pushed down
    # and the clause texts would be read twice.
    kept = [c for c in analysed.columns if c != "matches"]
    rows = df.select(*kept, F.explode_outer(F.array(conflict)).alias("c"))
    return rows.where("c IS NOT NULL").select(*kept, "c.*")


def match_rows(analysed: DataFrame, *keep: str) -> DataFrame:
    """One row per match, with its index in the clause (same reason for the outer form)."""
    rows = analysed.select(*keep, F.posexplode_outer("matches").alias("i", "m"))
    return rows.where("m IS NOT NULL").select(*keep, "i", "m.*")
