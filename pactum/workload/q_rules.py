"""Field rules, deadlines, terms and messages over the contract view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import field_rules as fr
from pactum.functions.dates import term_months
from pactum.workload.common import RULES, contract_fields, q, rules_values
from pactum.workload.registry import query
from pactum.workload.views import TODAY, oracle

V = ("contract_fields",)


def _one(rule_id: str, *values: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = fr.field_outcomes(contract_fields(spark, sf), RULES).where(
            F.col("rule_id") == rule_id
        )
        return rows.select(
            "contract_id",
            F.col("outcome.verdict").alias("verdict"),
            F.col("outcome.explanation").alias("explanation"),
            *[F.col("outcome.values")[v].alias(f"value_{v}") for v in values],
        )

    return run


def _limit(value: str, limit: int, op: str) -> str:
    return f"CASE WHEN {value}={limit} THEN 'compliant' WHEN {value}{op}{limit} THEN 'better_than_law' ELSE 'likely_void' END"


PROB_MAX = f"""SELECT contract_id, {_limit('probation_days', 180, '<')} AS verdict,
 'Probation is ' || probation_days || ' days; the legal maximum is 180 days in total.' AS explanation,
 CAST(probation_days AS VARCHAR) AS value_value FROM contract_fields WHERE probation_days IS NOT NULL"""
query("rule_prob_max", oracle(V, PROB_MAX))(_one("PROB-MAX-01", "value"))

PROB_EXCL = """SELECT contract_id, CASE WHEN excluded_days LIKE '%other%' THEN 'likely_void' ELSE 'compliant' END AS verdict,
 CASE WHEN excluded_days LIKE '%other%' THEN 'Days outside the regulations'' list also pause probation.' ELSE 'Only days on the regulations'' list pause probation.' END AS explanation
FROM contract_fields WHERE probation_days > 0"""
query("rule_prob_excl", oracle(V, PROB_EXCL))(_one("PROB-EXCL-01"))

LEAVE = f"""SELECT contract_id, {_limit('annual_leave_days', 21, '>')} AS verdict,
 'Annual leave is ' || annual_leave_days || ' days a year; the legal minimum is 21 days (30 after 5 years of service).' AS explanation,
 CAST(annual_leave_days AS VARCHAR) AS value_value, CAST(greatest(0, 21-annual_leave_days) AS VARCHAR) AS value_days
FROM contract_fields WHERE annual_leave_days IS NOT NULL"""
query("rule_leave_min", oracle(V, LEAVE))(_one("LEAVE-MIN-01", "value", "days"))

HOURS = """SELECT contract_id, CASE WHEN coalesce(daily_hours,0)>8 OR coalesce(wk,0)>48 THEN 'likely_void'
  WHEN CASE WHEN wk IS NOT NULL THEN wk<48 ELSE daily_hours<8 END THEN 'better_than_law' ELSE 'compliant' END AS verdict,
 'Normal hours are ' || concat_ws(' and ', daily_hours || ' a day', wk || ' a week') || '; the legal cap is ' ||
  CASE WHEN daily_hours IS NULL THEN '48 a week under the weekly criterion' ELSE '8 a day and 48 a week' END || '.' AS explanation,
 CAST(wk AS VARCHAR) AS value_value
FROM (SELECT *, coalesce(weekly_hours, daily_hours*work_days_per_week) wk FROM contract_fields) WHERE daily_hours IS NOT NULL OR wk IS NOT NULL"""
query("rule_hours_max", oracle(V, HOURS))(_one("HOURS-MAX-01", "value"))

OVERTIME = f"""SELECT contract_id, {_limit('overtime_premium_pct', 50, '>')} AS verdict,
 'Overtime pays the hourly wage plus ' || overtime_premium_pct || '% of the basic hourly wage; the legal minimum is 50%.' AS explanation,
 CAST(overtime_premium_pct AS VARCHAR) AS value_value FROM contract_fields WHERE overtime_premium_pct IS NOT NULL"""
query("rule_ot_rate", oracle(V, OVERTIME))(_one("OT-RATE-01", "value"))

MARKET = """SELECT contract_id, CASE WHEN short THEN 'worse_than_default' WHEN over THEN 'better_than_law' ELSE 'compliant' END AS verdict,
 'Housing is ' || CAST(h AS BIGINT) || '% of the basic wage (market norm about 25%) and transport is ' || CAST(t AS BIGINT) || '% (about 10%).' AS explanation,
 CASE WHEN short THEN 'below' WHEN over THEN 'above' ELSE 'in line with' END AS value_position
FROM (SELECT contract_id, h, t, h<20 OR t<7 AS short, h>30 OR t>13 AS over FROM
 (SELECT contract_id, round(housing*100.0/basic, 6) h, round(transport*100.0/basic, 6) t FROM contract_fields WHERE basic > 0))"""
query("rule_market_allow", oracle(V, MARKET))(_one("MARKET-ALLOW-01", "position"))

INFO = """SELECT contract_id, rule_id FROM contract_fields, (VALUES ('PROB-NOCOMP-01'),('RENEW-CONVERT-01'),('NOTICE-INDEF-01'),('SETTLE-TIME-01')) r(rule_id)
WHERE CASE rule_id WHEN 'PROB-NOCOMP-01' THEN coalesce(probation_days,1)<>0 WHEN 'RENEW-CONVERT-01' THEN contract_type='fixed_term' AND nationality='saudi'
 WHEN 'NOTICE-INDEF-01' THEN contract_type='indefinite' ELSE true END"""


@query("rule_info", oracle(V, INFO))
def rule_info(spark: SparkSession, sf: str) -> DataFrame:
    found = fr.field_findings(contract_fields(spark, sf), RULES)
    return found.where("source = 'info'").select("contract_id", "rule_id")


FOUND = f""", {rules_values()}
, o AS (SELECT contract_id, 'PROB-MAX-01' rule_id, verdict, explanation, value_value v, NULL p FROM ({PROB_MAX})
 UNION ALL SELECT contract_id, 'PROB-EXCL-01', verdict, explanation, NULL, NULL FROM ({PROB_EXCL})
 UNION ALL SELECT contract_id, 'LEAVE-MIN-01', verdict, explanation, value_value, NULL FROM ({LEAVE})
 UNION ALL SELECT contract_id, 'HOURS-MAX-01', verdict, explanation, value_value, NULL FROM ({HOURS})
 UNION ALL SELECT contract_id, 'OT-RATE-01', verdict, explanation, value_value, NULL FROM ({OVERTIME})
 UNION ALL SELECT contract_id, 'MARKET-ALLOW-01', verdict, explanation, NULL, value_position FROM ({MARKET})
 UNION ALL SELECT i.contract_id, i.rule_id, 'compliant', r.title, NULL, NULL FROM ({INFO}) i JOIN rules r USING (rule_id))
, found AS (SELECT o.contract_id, r.rule_order, o.rule_id, o.verdict, o.explanation, r.kind, r.title, r.categories, r.articles, r.impact, r.confidence,
 CASE WHEN o.verdict IN ('likely_void','conflict','worse_than_default','unclear') THEN r.severity_if_fail ELSE 'none' END severity,
 CASE r.kind WHEN 'info' THEN 'info' WHEN 'market' THEN 'market' ELSE 'field_rule' END source,
 CASE o.rule_id WHEN 'PROB-MAX-01' THEN '6.1' WHEN 'PROB-EXCL-01' THEN '6.1' WHEN 'PROB-NOCOMP-01' THEN '6.2' WHEN 'LEAVE-MIN-01' THEN '8.1' WHEN 'HOURS-MAX-01' THEN '7'
  WHEN 'OT-RATE-01' THEN '11.2' WHEN 'RENEW-CONVERT-01' THEN '5.1' WHEN 'MARKET-ALLOW-01' THEN '9.1.1' END clause,
 CASE WHEN r.kind='info' OR o.verdict IN ('likely_void','worse_than_default') THEN replace(r.employee_msg, '{{position}}', coalesce(p,'')) WHEN r.good_msg IS NULL THEN r.title
  WHEN r.good_msg LIKE '%{{value}}%' AND v IS NULL THEN r.title
  ELSE replace(replace(r.good_msg, '{{value}}', coalesce(v,'')), '{{position}}', coalesce(p,'')) END employee_msg,
 CASE WHEN r.kind='info' OR o.verdict IN ('likely_void','worse_than_default') THEN replace(r.hr_msg, '{{position}}', coalesce(p,'')) ELSE r.title END hr_msg
 FROM o JOIN rules r USING (rule_id))
"""


@query(
    "field_findings",
    oracle(V, FOUND + "SELECT contract_id, rule_id, clause, verdict, severity, confidence, categories, articles, source, explanation FROM found"),
)
def field_findings(spark: SparkSession, sf: str) -> DataFrame:
    return fr.field_findings(contract_fields(spark, sf), RULES).select(
        "contract_id", "rule_id", "clause", "verdict", "severity", "confidence",
        F.array_join("categories", ",").alias("categories"),
        F.array_join("articles", ",").alias("articles"), "source", "explanation",
    )


@query("msg_fill", oracle(V, FOUND + "SELECT contract_id, rule_id, employee_msg FROM found"))
def msg_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fr.field_findings(contract_fields(spark, sf), RULES).select("contract_id", "rule_id", "employee_msg")


@query("msg_choice", oracle(V, FOUND + "SELECT contract_id, rule_id, verdict, employee_msg, hr_msg FROM found"))
def msg_choice(spark: SparkSession, sf: str) -> DataFrame:
    return fr.field_findings(contract_fields(spark, sf), RULES).select(
        "contract_id", "rule_id", "verdict", "employee_msg", "hr_msg"
    )


TERM = """coalesce(term_months, CASE WHEN end_date IS NOT NULL AND end_date>=commencement_date THEN
 (SELECT min(n) FROM range(1,601) r(n) WHERE CAST(commencement_date+to_months(CAST(n AS INT)) AS DATE) > end_date) END)"""


@query("term_months", oracle(V, f"SELECT contract_id, CAST({TERM} AS INTEGER) AS months FROM contract_fields"))
def term_months_query(spark: SparkSession, sf: str) -> DataFrame:
    months = term_months(F.col("term_months"), F.col("commencement_date"), F.col("end_date"))
    return contract_fields(spark, sf).select("contract_id", months.alias("months"))


RENEWAL = f"""rn AS (SELECT contract_id, 'RENEW-DEADLINE-01' rule_id, 'renewal_notice' kind, date FROM (
 SELECT contract_id, CASE WHEN d0 >= DATE '{TODAY}' THEN d0 WHEN auto_renew AND term IS NOT NULL THEN
   (SELECT min(d) FROM (SELECT CAST(CAST(end_date+to_months(CAST(k*term AS INT)) AS DATE)-renewal_notice_days AS DATE) d FROM range(1,101) r(k)) WHERE d >= DATE '{TODAY}') END AS date
 FROM (SELECT *, CAST(end_date-renewal_notice_days AS DATE) d0, {TERM} term FROM contract_fields WHERE end_date IS NOT NULL AND renewal_notice_days IS NOT NULL AND coalesce(auto_renew, true))) WHERE date IS NOT NULL)"""
PROBATION = f"""pb AS (SELECT contract_id, 'PROB-NOCOMP-01' rule_id, 'probation_end' kind, date FROM (
 SELECT contract_id, CAST(commencement_date+least(probation_days,180)-1 AS DATE) AS date FROM contract_fields WHERE probation_days>0) WHERE date >= DATE '{TODAY}')"""


def _deadlines(spark: SparkSession, sf: str) -> DataFrame:
    return fr.deadlines(contract_fields(spark, sf), RULES, TODAY)


@query("deadline_renewal", oracle(V, f", {RENEWAL} SELECT contract_id, date FROM rn"))
def deadline_renewal(spark: SparkSession, sf: str) -> DataFrame:
    return _deadlines(spark, sf).where("kind = 'renewal_notice'").select("contract_id", "date")


@query("deadline_probation", oracle(V, f", {PROBATION} SELECT contract_id, date FROM pb"))
def deadline_probation(spark: SparkSession, sf: str) -> DataFrame:
    return _deadlines(spark, sf).where("kind = 'probation_end'").select("contract_id", "date")


_MSGS = {r["id"]: r for r in RULES.rules}
@query(
    "deadlines_sorted",
    oracle(V, f""", {RENEWAL}, {PROBATION}, a AS (SELECT *, 12 ord FROM rn UNION ALL SELECT *, 2 FROM pb)
SELECT contract_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY date, ord) AS INTEGER) AS deadline_no, rule_id, kind, date,
 CASE kind WHEN 'probation_end' THEN replace({q(fr.PROBATION_END_MSG[0])}, '{{deadline}}', CAST(date AS VARCHAR)) ELSE replace({q(_MSGS['RENEW-DEADLINE-01']['employeeMsg'])}, '{{deadline}}', CAST(date AS VARCHAR)) END AS employee_msg FROM a"""),
)
def deadlines_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return _deadlines(spark, sf).select(
        "contract_id", "deadline_no", "rule_id", "kind", "date", "employee_msg"
    )


@query(
    "field_summary",
    oracle(V, """SELECT contract_id, 'Contract type: ' || CASE contract_type WHEN 'fixed_term' THEN 'fixed-term' WHEN 'indefinite' THEN 'indefinite (open-ended)' ELSE 'not found' END || '. Start date: ' || commencement_date
 || '. End date: ' || coalesce(CAST(end_date AS VARCHAR),'not found') || '. Term: ' || coalesce(term_months || ' months','not found') || '. Renews automatically: ' || CASE WHEN auto_renew THEN 'yes' WHEN NOT auto_renew THEN 'no' ELSE 'not found' END
 || '. Non-renewal notice: ' || renewal_notice_days || ' days before the end date. Probation: ' || coalesce(probation_days || ' days','not found') || '. Working days per week: ' || work_days_per_week || '. Daily hours: ' || coalesce(CAST(daily_hours AS VARCHAR),'not found')
 || '. Weekly hours: ' || coalesce(CAST(weekly_hours AS VARCHAR),'not found') || '. Rest days per week: ' || rest_days_per_week || '. Annual leave: ' || coalesce(annual_leave_days || ' days a year','not found') || '. '
 || coalesce('Monthly wage (SAR): basic ' || format('{:,}', basic) || ', housing ' || format('{:,}', housing) || ', transport ' || format('{:,}', transport) || ', other allowances ' || format('{:,}', other) || ', total ' || format('{:,}', total) || '.', 'Monthly wage: not found.')
 || ' Overtime premium: ' || overtime_premium_pct || '% of the basic hourly wage.' AS summary FROM contract_fields"""),
)
def field_summary(spark: SparkSession, sf: str) -> DataFrame:
    return contract_fields(spark, sf).select("contract_id", fr.field_summary().alias("summary"))
