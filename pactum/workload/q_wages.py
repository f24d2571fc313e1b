"""Wage reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import wages
from pactum.workload.registry import query
from pactum.workload.views import load, oracle

VIEWS = ("contract_wages", "payroll_wages", "offer_wages")

# The oracle's own shape: full outer joins over per-source rows with duplicate counts.
_BASE = """, c AS (SELECT employee_id, count(*) n, max(name) name, max(basic) basic, max(housing) housing, max(transport) transport, max(total) total FROM contract_wages GROUP BY 1)
, p AS (SELECT employee_id, count(*) n, max(name) name, max(basic) basic, max(housing) housing, max(transport) transport, max(total) total FROM payroll_wages GROUP BY 1)
, o AS (SELECT employee_id, count(*) n, max(name) name, max(basic) basic, max(housing) housing, max(transport) transport, max(total) total FROM offer_wages GROUP BY 1)
, ids AS (SELECT employee_id FROM c UNION SELECT employee_id FROM p UNION SELECT employee_id FROM o)
, gaps AS (
 SELECT employee_id, src, fno, field, CAST(expected AS DOUBLE) expected, CAST(actual AS DOUBLE) actual, CAST(actual-expected AS DOUBLE) gap FROM (
  SELECT c.employee_id, 'payroll' src, x.fno, x.field, x.expected, x.actual FROM c JOIN p USING (employee_id), LATERAL (VALUES (0,'basic',c.basic,p.basic),(1,'housing',c.housing,p.housing),(2,'transport',c.transport,p.transport),(3,'total',c.total,p.total)) x(fno,field,expected,actual) WHERE c.n=1 AND p.n=1
  UNION ALL
  SELECT c.employee_id, 'offer', x.fno, x.field, x.expected, x.actual FROM c JOIN o USING (employee_id), LATERAL (VALUES (0,'basic',c.basic,o.basic),(1,'housing',c.housing,o.housing),(2,'transport',c.transport,o.transport),(3,'total',c.total,o.total)) x(fno,field,expected,actual) WHERE c.n=1 AND o.n=1
 ) q WHERE expected IS NOT NULL AND actual IS NOT NULL AND expected<>actual AND NOT (src='payroll' AND field IN ('transport','total') AND actual>expected))
, gap_issues AS (SELECT employee_id, (CASE src WHEN 'payroll' THEN 3 ELSE 7 END)+fno AS ord,
  CASE WHEN src='offer' THEN 'offer_differs' WHEN field='total' THEN 'underpaid' ELSE 'payroll_differs' END kind, field, expected, actual, gap,
  CASE WHEN src='offer' OR gap>0 THEN '' WHEN field='basic' THEN '61,84,77' ELSE '61' END articles,
  CASE WHEN src='offer' THEN 'Offer letter: ' || format('{:,}', CAST(abs(gap) AS BIGINT)) || ' SAR ' || CASE WHEN gap<0 THEN 'less' ELSE 'more' END || ' ' || field || ' than Qiwa.'
       WHEN field='total' THEN 'Underpaid ' || format('{:,}', CAST(-gap AS BIGINT)) || ' SAR this month.'
       ELSE 'Payroll: ' || format('{:,}', CAST(abs(gap) AS BIGINT)) || ' SAR ' || CASE WHEN gap<0 THEN 'less' ELSE 'more' END || ' ' || field || ' than Qiwa.' END message FROM gaps)
, dup AS (SELECT employee_id, 0 AS ord, 'the Qiwa contracts' src FROM c WHERE n>1 UNION ALL SELECT employee_id, 1, 'the offer letters' FROM o WHERE n>1 UNION ALL SELECT employee_id, 2, 'payroll' FROM p WHERE n>1)
, all_issues AS (
  SELECT employee_id, ord, 'duplicate' kind, CAST(NULL AS VARCHAR) field, CAST(NULL AS DOUBLE) expected, CAST(NULL AS DOUBLE) actual, CAST(NULL AS DOUBLE) gap, '' articles, 'Listed more than once in ' || src || '. Check which row is right.' message FROM dup
  UNION ALL SELECT * FROM gap_issues
  UNION ALL SELECT i.employee_id, 11, 'no_contract', NULL, NULL, NULL, NULL, '37', CASE WHEN p.employee_id IS NOT NULL THEN 'Paid through payroll, but there is no Qiwa contract for this ID.' ELSE 'Has an offer letter, but there is no Qiwa contract for this ID.' END FROM ids i LEFT JOIN c ON c.employee_id=i.employee_id LEFT JOIN p ON p.employee_id=i.employee_id WHERE c.employee_id IS NULL
  UNION ALL SELECT c.employee_id, 12, 'not_paid', 'total', NULL, NULL, NULL, '61', 'Has a Qiwa contract but is missing from this month''s payroll.' FROM c LEFT JOIN p USING (employee_id) WHERE p.employee_id IS NULL)
"""


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(load(spark, sf, v) for v in ("contract_wages", "offer_wages", "payroll_wages"))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return wages.check_wages(*_sources(spark, sf))


def _flat(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    rows = wages.issue_rows(_checked(spark, sf))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.select(
        "employee_id", "kind", "field", "expected", "actual", "gap",
        F.array_join("articles", ",").alias("articles"), "message",
    )


_COLS = "employee_id, kind, field, expected, actual, gap, articles, message"


@query("wage_issues", oracle(VIEWS, _BASE + f"SELECT {_COLS} FROM all_issues"))
def wage_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf)


@query(
    "wage_full_outer",
    oracle(VIEWS, _BASE + """SELECT i.employee_id, coalesce(p.name, c.name, o.name) AS name, CAST(coalesce(c.n,0) AS BIGINT) AS contract_n, CAST(coalesce(o.n,0) AS BIGINT) AS offer_n, CAST(coalesce(p.n,0) AS BIGINT) AS payroll_n
FROM ids i LEFT JOIN c USING (employee_id) LEFT JOIN o USING (employee_id) LEFT JOIN p USING (employee_id)"""),
)
def wage_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return wages.combine_sources(*_sources(spark, sf)).select(
        "employee_id",
        F.coalesce("payroll.name", "contract.name", "offer.name").alias("name"),
        "contract_n", "offer_n", "payroll_n",
    )


@query("wage_duplicates", oracle(VIEWS, _BASE + f"SELECT {_COLS} FROM all_issues WHERE kind='duplicate'"))
def wage_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "duplicate")


@query("wage_gaps", oracle(VIEWS, _BASE + f"SELECT {_COLS} FROM gap_issues"))
def wage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "payroll_differs", "underpaid", "offer_differs")


@query("wage_no_contract", oracle(VIEWS, _BASE + f"SELECT {_COLS} FROM all_issues WHERE kind='no_contract'"))
def wage_no_contract(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "no_contract")


@query("wage_not_paid", oracle(VIEWS, _BASE + f"SELECT {_COLS} FROM all_issues WHERE kind='not_paid'"))
def wage_not_paid(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "not_paid")


@query("wage_summary", oracle(VIEWS, _BASE + """SELECT CAST(count(*) AS BIGINT) AS employees, CAST(count(*) FILTER (WHERE employee_id IN (SELECT employee_id FROM all_issues)) AS BIGINT) AS flagged FROM ids"""))
def wage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return wages.summary(_checked(spark, sf))


@query(
    "wage_response",
    oracle(VIEWS, _BASE + """SELECT i.employee_id, coalesce(p.name, c.name, o.name) AS name, coalesce(a.issues,'') AS issues
FROM ids i LEFT JOIN c USING (employee_id) LEFT JOIN o USING (employee_id) LEFT JOIN p USING (employee_id)
LEFT JOIN (SELECT employee_id, string_agg(kind || ':' || coalesce(field,'-'), ';' ORDER BY ord) issues FROM all_issues GROUP BY 1) a USING (employee_id)"""),
)
def wage_response(spark: SparkSession, sf: str) -> DataFrame:
    issues = F.transform(
        "issues", lambda i: F.concat(i["kind"], F.lit(":"), F.coalesce(i["field"], F.lit("-")))
    )
    return wages.flagged_first(_checked(spark, sf)).select(
        "employee_id", "name", F.array_join(issues, ";").alias("issues")
    )


@query(
    "wage_before_payroll",
    oracle(VIEWS, _BASE + f"""SELECT employee_id, kind, field, expected, actual, gap, articles,
 CASE WHEN kind='no_contract' THEN 'Has an offer letter, but there is no Qiwa contract for this ID.' ELSE message END AS message
FROM all_issues WHERE kind='offer_differs' OR (kind='duplicate' AND ord<2) OR (kind='no_contract' AND employee_id IN (SELECT employee_id FROM o))"""),
)
def wage_before_payroll(spark: SparkSession, sf: str) -> DataFrame:
    contracts, offers, _ = _sources(spark, sf)
    rows = wages.issue_rows(wages.check_wages(contracts, offers))
    return rows.select(
        "employee_id", "kind", "field", "expected", "actual", "gap",
        F.array_join("articles", ",").alias("articles"), "message",
    )


@query(
    "wage_from_contract",
    oracle(("contract_fields",), """SELECT contract_id AS employee_id, CAST(basic AS DOUBLE) AS basic, CAST(housing AS DOUBLE) AS housing, CAST(transport+other AS DOUBLE) AS transport, CAST(total AS DOUBLE) AS total
FROM contract_fields WHERE basic IS NOT NULL"""),
)
def wage_from_contract(spark: SparkSession, sf: str) -> DataFrame:
    fields = load(spark, sf, "contract_fields").withColumnRenamed("contract_id", "employee_id")
    return wages.wage_from_contract(fields).drop("name")


_FORM = """SELECT c_custkey AS employee_id, c_name AS name,
 CASE WHEN c_custkey%4=1 THEN '' WHEN c_custkey%4=2 THEN CAST(3000+c_custkey%170*100 AS {s}) END AS offer_basic,
 CASE WHEN c_custkey%4=3 THEN ' 1,250.50 ' ELSE '' END AS offer_housing,
 CAST(NULL AS {s}) AS offer_transport,
 CASE WHEN c_custkey%5=0 THEN '12,000' END AS offer_total FROM {t}"""


@query(
    "wage_offer_rows",
    f"""WITH form AS ({_FORM.format(s='VARCHAR', t='customer')}), r AS (SELECT employee_id, name,
 TRY_CAST(nullif(regexp_replace(offer_basic,'[,\\s]','','g'),'') AS DOUBLE) basic, TRY_CAST(nullif(regexp_replace(offer_housing,'[,\\s]','','g'),'') AS DOUBLE) housing,
 CAST(NULL AS DOUBLE) transport, TRY_CAST(nullif(regexp_replace(offer_total,'[,\\s]','','g'),'') AS DOUBLE) total FROM form)
SELECT * FROM r WHERE coalesce(basic,housing,transport,total) IS NOT NULL""",
)
def wage_offer_rows(spark: SparkSession, sf: str) -> DataFrame:
    form = spark.sql(_FORM.format(s="STRING", t="{customer}"), customer=load(spark, sf, "customer"))
    return wages.offers_from_form(form)
