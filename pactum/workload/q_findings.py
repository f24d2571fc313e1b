"""Impact, scores, orders, buckets and passages over the findings view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.numbers import round_half_up
from pactum.operators import field_rules, impact, report, score
from pactum.operators.rule_table import candidate_rules
from pactum.operators.verdicts import is_problem
from pactum.workload.common import RULES, contract_fields, rules_values
from pactum.workload.q_rules import TERM
from pactum.workload.registry import query
from pactum.workload.views import load, oracle, together

V = ("finding_rows",)
VF = ("finding_rows", "contract_fields")


def findings(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    f = load(spark, sf, "finding_rows", parts=parts)
    params = F.struct(
        F.col("eos_base").alias("eos_base"),
        F.col("comp_months").alias("compensation_months"),
        F.col("comp_base").alias("compensation_base"),
        F.lit(None).cast("double").alias("non_compete_months"),
    )
    return f.withColumns(
        {"impact_params": params, "categories": F.split("categories", ",")}
    ).drop("eos_base", "comp_months", "comp_base")


def priced(spark: SparkSession, sf: str) -> DataFrame:
    return impact.apply_impact(findings(spark, sf), contract_fields(spark, sf))


# The oracle prices findings with plain arithmetic; all amounts are whole or half riyals but
# the leave value, which is rounded to two places on both sides.
PRICED = f""", fx AS (SELECT contract_id fid, contract_type, CAST(basic AS DOUBLE) basic, CAST(CASE WHEN basic IS NOT NULL THEN total END AS DOUBLE) total, annual_leave_days, CASE WHEN contract_type='fixed_term' THEN {TERM} END term FROM contract_fields)
, j AS (SELECT f.*, fx.*, verdict IN ('likely_void','conflict','worse_than_default','unclear') prob,
 CASE WHEN comp_base='basic' THEN basic ELSE total END * comp_months pays, total*coalesce(term,2) dflt FROM finding_rows f LEFT JOIN fx ON f.contract_id=fx.fid)
, k AS (SELECT *, coalesce(prob AND impact_kind='art77_gap' AND pays IS NOT NULL AND total IS NOT NULL, false) p77 FROM j)
, priced AS (SELECT contract_id, position, rule_id, source, clause, related_clause, categories, needs_review, impact_kind,
 CASE WHEN p77 AND dflt-pays<=0 THEN 'compliant' ELSE verdict END verdict,
 CASE WHEN p77 AND dflt-pays<=0 THEN 'none' WHEN p77 AND verdict='worse_than_default' AND dflt-pays>=6*total THEN 'high' ELSE severity END severity,
 CASE WHEN prob AND impact_kind='eos_gap' AND eos_base='basic' AND total-basic>0 THEN 'eos_gap' WHEN p77 THEN 'art77_gap'
  WHEN prob AND impact_kind='leave_value' AND source<>'clause' AND annual_leave_days<21 AND total IS NOT NULL THEN 'leave_value' END kind,
 (total-basic)/2 g1, 5*(total-basic)/2 g5, 5*(total-basic)/2+5*(total-basic) g10, pays, dflt, dflt-pays gap, floor((21-annual_leave_days)*(total/30)*100+0.5)/100 leave FROM k)
, staked AS (SELECT *, CAST(coalesce(CASE kind WHEN 'eos_gap' THEN g5 WHEN 'art77_gap' THEN gap WHEN 'leave_value' THEN leave END, 0) AS DOUBLE) stake,
 verdict IN ('likely_void','conflict','worse_than_default','unclear') prob2,
 CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END srank,
 CASE verdict WHEN 'likely_void' THEN 0 WHEN 'conflict' THEN 1 WHEN 'worse_than_default' THEN 2 WHEN 'unclear' THEN 3 WHEN 'compliant' THEN 4 ELSE 5 END lrank FROM priced)
"""


@query("impact_dispatch", oracle(VF, PRICED + "SELECT contract_id, position, rule_id, verdict, severity, kind AS impact_kind FROM priced"))
def impact_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return priced(spark, sf).select(
        "contract_id", "position", "rule_id", "verdict", "severity",
        F.col("impact.kind").alias("impact_kind"),
    )


def _figures(kind: str, names: dict[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = priced(spark, sf).where(F.col("impact.kind") == kind)
        return rows.select(
            "contract_id", "position", "verdict", "severity",
            F.array_join(impact.impact_columns(F.col("impact")), ",").alias("figures"),
            *[F.col("impact.sar")[key].alias(alias) for key, alias in names.items()],
        )

    return run


_P = PRICED + "SELECT contract_id, position, verdict, severity, "
query("impact_eos", oracle(VF, _P + "'1y,5y,10y' AS figures, g1 AS y1, g5 AS y5, g10 AS y10 FROM priced WHERE kind='eos_gap'"))(
    _figures("eos_gap", {"1y": "y1", "5y": "y5", "10y": "y10"})
)
query("impact_art77", oracle(VF, _P + "'contract,default,gap' AS figures, pays AS contract_pays, dflt AS law_pays, gap FROM priced WHERE kind='art77_gap'"))(
    _figures("art77_gap", {"contract": "contract_pays", "default": "law_pays", "gap": "gap"})
)
query("impact_leave", oracle(VF, _P + "'perYear' AS figures, leave AS per_year FROM priced WHERE kind='leave_value'"))(
    _figures("leave_value", {"perYear": "per_year"})
)


@query("sar_at_stake", oracle(VF, PRICED + "SELECT contract_id, position, stake FROM staked"))
def sar_at_stake(spark: SparkSession, sf: str) -> DataFrame:
    rows = priced(spark, sf)
    return rows.select("contract_id", "position", impact.sar_at_stake(F.col("impact")).alias("stake"))


SUBS = """, sc AS (SELECT contract_id, cat, sum(d) d, max(serious) serious FROM (
 SELECT contract_id, unnest(string_split(categories,',')) cat, CASE WHEN source<>'info' AND prob2 THEN -CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END ELSE 0 END d, 0 serious FROM staked
 UNION ALL SELECT contract_id, string_split(categories,',')[1], CASE WHEN source<>'info' AND verdict='better_than_law' THEN 2 ELSE 0 END, 0 FROM staked
 UNION ALL SELECT contract_id, 'legal', 0, 0 FROM contract_fields) GROUP BY 1,2)
, ser AS (SELECT contract_id, count(*) n FROM staked WHERE source<>'info' AND severity='high' AND verdict IN ('likely_void','conflict') GROUP BY 1)
, subs AS (SELECT b.contract_id, CAST(greatest(0,least(100,100+coalesce(max(d) FILTER (WHERE cat='legal'),0))) AS INTEGER) legal, CAST(greatest(0,least(100,100+coalesce(max(d) FILTER (WHERE cat='market'),0))) AS INTEGER) market,
 CAST(greatest(0,least(100,100+coalesce(max(d) FILTER (WHERE cat='clarity'),0))) AS INTEGER) clarity, CAST(coalesce(max(ser.n),0) AS BIGINT) serious
 FROM sc b LEFT JOIN ser USING (contract_id) GROUP BY 1)
, ov AS (SELECT s.*, v.view, CAST(floor((legal*v.l+market*v.m+clarity*v.c+50)/100) AS INTEGER) raw, CASE WHEN serious>=3 THEN 59 WHEN serious>=1 THEN 79 ELSE 100 END cap FROM subs s, (VALUES ('employee',40,35,25),('hr',60,10,30)) v(view,l,m,c))
"""
_BAND = "CASE WHEN {o}>=80 THEN 'Good' WHEN {o}>=60 THEN 'Fair' WHEN {o}>=40 THEN 'Weak' ELSE 'Poor' END"


def _subs(spark: SparkSession, sf: str) -> DataFrame:
    return score.sub_scores(priced(spark, sf), contract_fields(spark, sf))


@query("sub_scores", oracle(VF, PRICED + SUBS + "SELECT contract_id, legal, market, clarity, serious FROM subs"))
def sub_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _subs(spark, sf)


@query("overall_scores", oracle(VF, PRICED + SUBS + f"SELECT contract_id, view, raw AS overall, {_BAND.format(o='raw')} AS band FROM ov"))
def overall_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score.overall_scores(_subs(spark, sf), capped=False).select(
        "contract_id", "view", "overall", "band"
    )


@query("capped_scores", oracle(VF, PRICED + SUBS + f"SELECT contract_id, view, legal, market, clarity, CAST(least(raw,cap) AS INTEGER) AS overall, {_BAND.format(o='least(raw,cap)')} AS band, 'low' AS market_confidence FROM ov"))
def capped_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score.overall_scores(_subs(spark, sf))


_NEEDS = """, need AS (SELECT contract_id, contract_type, commencement_date, probation_days, annual_leave_days, basic, daily_hours, weekly_hours,
 [x FOR x IN [CASE WHEN contract_type='unknown' THEN 'contract_type' END, CASE WHEN commencement_date IS NULL THEN 'commencement_date' END, CASE WHEN probation_days IS NULL THEN 'probation_days' END,
  CASE WHEN annual_leave_days IS NULL THEN 'annual_leave_days' END, CASE WHEN basic IS NULL THEN 'wage' END, CASE WHEN daily_hours IS NULL AND weekly_hours IS NULL THEN 'weekly_hours' END] IF x IS NOT NULL] issues FROM contract_fields)
"""
_MSG = "CASE x WHEN 'weekly_hours' THEN 'Neither daily nor weekly working hours were found.' ELSE 'Required field ' || x || ' was not found.' END"


def _needs(spark: SparkSession, sf: str) -> DataFrame:
    from pactum.operators.extract import required_issues

    f = contract_fields(spark, sf)
    issues = required_issues()
    return f.select("contract_id", issues.alias("issues")).withColumn(
        "needs_review", F.size("issues") > 0
    )


@query("needs_review", oracle(("contract_fields",), _NEEDS + f"SELECT contract_id, array_to_string(issues, ',') AS fields, len(issues)>0 AS needs_review FROM need"))
def needs_review(spark: SparkSession, sf: str) -> DataFrame:
    return _needs(spark, sf).select(
        "contract_id",
        F.array_join(F.transform("issues", lambda i: i["field"]), ",").alias("fields"),
        "needs_review",
    )


_STATUS = ", st AS (SELECT n.contract_id, CASE WHEN len(issues)>0 OR coalesce(f.r,false) THEN 'needs_review' ELSE 'done' END status, issues, coalesce(f.r,false) r FROM need n LEFT JOIN (SELECT contract_id, bool_or(needs_review) r FROM finding_rows GROUP BY 1) f USING (contract_id))\n"


@query("rating_status", oracle(VF, _NEEDS + _STATUS + "SELECT contract_id, status FROM st"))
def rating_status(spark: SparkSession, sf: str) -> DataFrame:
    return score.rating_status(_needs(spark, sf), findings(spark, sf))


@query(
    "review_reasons",
    oracle(VF, _NEEDS + _STATUS + f"""SELECT contract_id, CASE WHEN status='done' THEN '' ELSE array_to_string(list_concat([{_MSG} FOR x IN issues], CASE WHEN r THEN ['One or more Section 15 clauses could not be analysed automatically; check them by hand.'] ELSE [] END), '|') END AS reasons FROM st"""),
)
def review_reasons(spark: SparkSession, sf: str) -> DataFrame:
    contracts, found = _needs(spark, sf), findings(spark, sf)
    status = score.rating_status(contracts, found)
    rows = score.review_reasons(contracts.join(status, "contract_id"), found)
    return rows.select("contract_id", F.array_join("reasons", "|").alias("reasons"))


def _rules(spark: SparkSession) -> DataFrame:
    return RULES.df(spark)


@query(
    "findings_bucket",
    oracle(V, f""", {rules_values()} SELECT f.contract_id, f.position, f.rule_id, CASE WHEN f.source='info' THEN 'info' WHEN verdict IN ('likely_void','conflict','worse_than_default','unclear') THEN 'problem' WHEN r.good_msg IS NOT NULL THEN 'good' END AS bucket
FROM finding_rows f LEFT JOIN rules r USING (rule_id)"""),
)
def findings_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return report.with_rules(findings(spark, sf), _rules(spark)).select(
        "contract_id", "position", "rule_id", "bucket"
    )


@query(
    "finding_titles",
    oracle(V, f""", {rules_values()} SELECT f.contract_id, f.position, coalesce(r.title, CASE WHEN f.rule_id='REVIEW-00' THEN 'Needs a manual review' ELSE f.rule_id END) AS title,
 'finding-' || f.rule_id || coalesce('-' || replace(f.clause, '.', '-'), '') AS anchor FROM finding_rows f LEFT JOIN rules r USING (rule_id)"""),
)
def finding_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.with_rules(findings(spark, sf), _rules(spark))
    anchor = report.finding_anchor(F.col("rule_id"), F.col("clause"))
    return rows.select("contract_id", "position", "title", anchor.alias("anchor"))


@query(
    "rule_candidates",
    oracle(V, f""", {rules_values()} SELECT r.rule_id, r.kind, CAST(count(f.contract_id) AS BIGINT) AS findings, CAST(count(*) FILTER (WHERE f.verdict IN ('likely_void','conflict','worse_than_default','unclear')) AS BIGINT) AS problems
FROM rules r LEFT JOIN finding_rows f USING (rule_id) WHERE r.kind='clause' OR (r.kind='field' AND r.has_detect) GROUP BY 1,2"""),
)
def rule_candidates(spark: SparkSession, sf: str) -> DataFrame:
    candidates = candidate_rules(_rules(spark)).select(F.col("id").alias("rule_id"), "kind")
    # Counted per rule first: at most one row per rule id reaches the join.
    counts = findings(spark, sf).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(is_problem(F.col("verdict"))).alias("problems"),
    )
    return candidates.join(counts, "rule_id", "left").select(
        "rule_id", "kind",
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("problems", F.lit(0)).alias("problems"),
    )


@query("severity_filter", oracle(V, "SELECT contract_id, position, rule_id, verdict FROM finding_rows WHERE severity='high' AND verdict='likely_void'"))
def severity_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.likely_void(report.filter_by_severity(findings(spark, sf), "high"))
    return rows.select("contract_id", "position", "rule_id", "verdict")


_ORDER = "SELECT contract_id, position, rule_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY {by}) AS INTEGER) AS rank FROM staked WHERE source<>'info' AND prob2"


def _order(view: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return report.order_findings(priced(spark, sf), view).select(
            "contract_id", "position", "rule_id", "rank"
        )

    return run


query("order_employee", oracle(VF, PRICED + _ORDER.format(by="stake DESC, srank, position")))(_order("employee"))
query("order_hr", oracle(VF, PRICED + _ORDER.format(by="srank, lrank, position")))(_order("hr"))


@query("findings_position", oracle(V, "SELECT contract_id, rule_id, clause, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY position)-1 AS BIGINT) AS position FROM finding_rows"))
def findings_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings(spark, sf).withColumnRenamed("position", "step_order")
    return report.with_positions(rows, "step_order").select(
        "contract_id", "rule_id", "clause", "position"
    )


@query(
    "findings_union",
    oracle(V, """SELECT contract_id, rule_id, source, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY CASE source WHEN 'clause' THEN 1 WHEN 'cross_check' THEN 2 ELSE 0 END, position)-1 AS BIGINT) AS position FROM finding_rows"""),
)
def findings_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = findings(spark, sf).withColumnRenamed("position", "step_order")
    source = F.col("source")
    steps = [
        rows.where(~source.isin("clause", "cross_check")),
        rows.where(source == "clause"),
        rows.where(source == "cross_check"),
    ]
    tagged = [df.withColumn("step", F.lit(i)) for i, df in enumerate(steps)]
    return report.union_steps(*tagged).select("contract_id", "rule_id", "source", "position")


# --- passages ----------------------------------------------------------------------------

VP = ("finding_rows", "clause_locations", "clause_texts")
PASS = """, refs AS (SELECT contract_id, position, 0 ref_no, clause reference FROM finding_rows WHERE clause IS NOT NULL
 UNION ALL SELECT contract_id, position, CASE WHEN clause IS NULL THEN 0 ELSE 1 END, related_clause FROM finding_rows WHERE related_clause IS NOT NULL AND related_clause IS DISTINCT FROM clause)
, anc AS (SELECT *, array_to_string(list_slice(string_split(reference,'.'),1,k),'.') a FROM (SELECT *, unnest(range(1,len(string_split(reference,'.'))+1)) k FROM refs))
, hit AS (SELECT anc.*, l.page, l.page_width, l.page_height, l.x_min, l.y_min, l.x_max, l.y_max FROM anc JOIN clause_locations l ON l.contract_id=anc.contract_id AND l.clause=anc.a)
, best AS (SELECT contract_id, position, ref_no, reference, a clause, page, page_width, page_height, y_min, y_max FROM hit QUALIFY k = max(k) OVER (PARTITION BY contract_id, position, ref_no))
, pas AS (SELECT b.*, t.text_en, t.text_ar, b.clause<>b.reference approximate, CAST(row_number() OVER (PARTITION BY b.contract_id, b.position, b.ref_no ORDER BY page, y_min)-1 AS INTEGER) box_no FROM best b LEFT JOIN clause_texts t ON t.contract_id=b.contract_id AND t.clause=b.clause)
"""


def _passages(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    parts = together(spark, sf, "orders", "lineitem")
    return report.passages(
        findings(spark, sf, parts),
        load(spark, sf, "clause_locations", parts=parts),
        load(spark, sf, "clause_texts", parts=parts) if texts else None,
    )


@query("passages", oracle(VP, PASS + "SELECT contract_id, position, CAST(ref_no AS INTEGER) AS ref_no, box_no, clause, page, y_min, y_max, text_en, text_ar, approximate FROM pas"))
def passages(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf, texts=True).select(
        "contract_id", "position", "ref_no", "box_no", "clause", "page", "y_min", "y_max",
        "text_en", "text_ar", "approximate",
    )


ITEMS = """, items AS (SELECT f.*, CASE WHEN verdict IN ('likely_void','conflict','worse_than_default','unclear') THEN 'issues' ELSE 'good' END tab FROM finding_rows f WHERE source<>'info')
"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    tab = F.when(is_problem(F.col("verdict")), "issues").otherwise("good")
    parts = together(spark, sf, "orders", "lineitem")
    return findings(spark, sf, parts).where("source <> 'info'").withColumn("tab", tab)


@query(
    "contract_numbering",
    oracle(VP, PASS + ITEMS + """, fp AS (SELECT contract_id, position, clause pclause, page, y_min, approximate FROM pas QUALIFY row_number() OVER (PARTITION BY contract_id, position ORDER BY ref_no, box_no)=1)
, nb AS (SELECT i.contract_id, i.position, i.tab, i.severity, CASE WHEN coalesce(NOT approximate,false) THEN row_number() OVER (PARTITION BY i.contract_id, i.tab, coalesce(NOT approximate,false) ORDER BY page, y_min, pclause, i.position) END number FROM items i LEFT JOIN fp ON fp.contract_id=i.contract_id AND fp.position=i.position)
SELECT contract_id, position, tab, CAST(number AS INTEGER) AS number, CAST(row_number() OVER (PARTITION BY contract_id, tab ORDER BY CASE WHEN tab='issues' THEN CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END ELSE 0 END, number NULLS LAST, position) AS INTEGER) AS list_no FROM nb"""),
)
def contract_numbering(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.contract_numbering(_items(spark, sf), _passages(spark, sf))
    return rows.select("contract_id", "position", "tab", "number", "list_no")


@query("page_marks", oracle(VP, PASS + ITEMS + "SELECT i.contract_id, i.position, p.clause, p.page, CASE WHEN i.tab='good' THEN 'good' ELSE CASE i.severity WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'serious' WHEN 'low' THEN 'warning' ELSE 'neutral' END END AS tone FROM items i JOIN pas p ON p.contract_id=i.contract_id AND p.position=i.position"))
def page_marks(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).drop("clause", "related_clause")
    return report.page_marks(items, _passages(spark, sf)).select(
        "contract_id", "position", "clause", "page", "tone"
    )


@query(
    "page_sizes",
    oracle(VP, PASS + """SELECT o_orderkey AS contract_id, CAST(g.page AS INTEGER) AS page, CAST(coalesce(k.w, 595.92) AS DOUBLE) AS width, CAST(coalesce(k.h, 842.04) AS DOUBLE) AS height
FROM orders, range(1,9) g(page) LEFT JOIN (SELECT contract_id, page, max(page_width) w, max(page_height) h FROM pas GROUP BY 1,2) k ON k.contract_id=o_orderkey AND k.page=g.page WHERE g.page <= 4+o_orderkey%5"""),
)
def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("contract_id"), (4 + F.col("o_orderkey") % 5).cast("int").alias("pages")
    )
    return report.page_sizes(documents, _passages(spark, sf))


# --- stored fields -----------------------------------------------------------------------

FIELD_TYPES = {
    "contract_type": "string", "commencement_date": "date", "end_date": "date", "term_months": "int",
    "auto_renew": "boolean", "renewal_notice_days": "int", "probation_days": "int",
    "annual_leave_days": "int", "daily_hours": "int", "overtime_premium_pct": "int",
}


def _field_rows(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    known = [n for n in FIELD_TYPES if n != "daily_hours"]
    pages = F.map_from_arrays(
        F.array(*[F.lit(n) for n in known]), F.array(*[F.lit(1 + i % 4) for i in range(len(known))])
    )
    conf = F.map_from_arrays(F.array(*[F.lit(n) for n in known]), F.array(*[F.lit("high")] * len(known)))
    f = contract_fields(spark, sf, parts).withColumns({"pages": pages, "confidences": conf})
    return report.fields_to_rows(f, list(FIELD_TYPES))


def _unpivot_sql() -> str:
    parts = []
    for i, (n, t) in enumerate((n, t) for n, t in FIELD_TYPES.items()):
        value = f"'\"' || CAST({n} AS VARCHAR) || '\"'" if t in ("string", "date") else f"CAST({n} AS VARCHAR)"
        known = [x for x in FIELD_TYPES if x != "daily_hours"]
        page = "NULL" if n == "daily_hours" else str(1 + known.index(n) % 4)
        conf = "low" if n == "daily_hours" else "high"
        parts.append(f"SELECT contract_id, '{n}' AS field, {value} AS value, CAST({page} AS INTEGER) AS page, '{conf}' AS confidence FROM contract_fields")
    return " UNION ALL ".join(parts)


@query("fields_unpivot", oracle(("contract_fields",), _unpivot_sql()))
def fields_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return _field_rows(spark, sf)


@query(
    "fields_pivot",
    oracle(("contract_fields",), "SELECT contract_id, coalesce(contract_type,'unknown') AS contract_type, " + ", ".join(n for n in FIELD_TYPES if n != "contract_type") + " FROM contract_fields"),
)
def fields_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return report.rows_to_fields(_field_rows(spark, sf), FIELD_TYPES, {"contract_type": F.lit("unknown")})


@query(
    "report_assemble",
    oracle(("finding_rows", "clause_locations", "clause_texts", "contract_fields", "stored_documents"), f""", fr AS ({_unpivot_sql()})
SELECT o_orderkey AS contract_id, coalesce(a.n,0) AS findings, coalesce(b.n,0) AS fields, coalesce(c.n,0) AS clauses, coalesce(d.n,0) AS locations, s.document_id IS NOT NULL AND s.deleted_at IS NULL AS available, s.pages AS pages
FROM orders LEFT JOIN (SELECT contract_id, CAST(count(*) AS INTEGER) n FROM finding_rows GROUP BY 1) a ON a.contract_id=o_orderkey LEFT JOIN (SELECT contract_id, CAST(count(*) AS INTEGER) n FROM fr GROUP BY 1) b ON b.contract_id=o_orderkey
LEFT JOIN (SELECT contract_id, CAST(count(*) AS INTEGER) n FROM clause_texts GROUP BY 1) c ON c.contract_id=o_orderkey LEFT JOIN (SELECT contract_id, CAST(count(*) AS INTEGER) n FROM clause_locations GROUP BY 1) d ON d.contract_id=o_orderkey
LEFT JOIN stored_documents s ON s.document_id=o_orderkey AND s.user_id=o_orderkey%150"""),
)
def report_assemble(spark: SparkSession, sf: str) -> DataFrame:
    parts = together(spark, sf, "orders", "lineitem")
    ratings = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("contract_id"),
        F.col("o_orderkey").alias("document_id"),
        (F.col("o_orderkey") % 150).alias("user_id"),
    )
    rows = report.assemble(
        ratings,
        findings(spark, sf, parts).drop("impact_params"),
        _field_rows(spark, sf, parts),
        load(spark, sf, "clause_texts", parts=parts),
        load(spark, sf, "clause_locations", parts=parts),
        load(spark, sf, "stored_documents"),
    )
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(c)
    return rows.select(
        "contract_id", *[count(c) for c in ("findings", "fields", "clauses", "locations")],
        F.coalesce("document.available", F.lit(False)).alias("available"),
        F.col("document.pages").alias("pages"),
    )
