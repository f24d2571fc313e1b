"""Layout and extraction queries over contracts laid out from the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.operators import extract, layout
from pactum.plans.rate import rate_layouts
from pactum.workload.common import RULES
from pactum.workload.registry import query
from pactum.workload.views import load, oracle, view

# (page, y, x, text); {placeholders} are filled per customer below.
CELLS = [
    (1, 40, 180, "Unified Employment Contract"), (1, 70, 40, "1. Contract Information"),
    (1, 90, 40, "Contract type:"), (1, 90, 180, "{type}"), (1, 92, 400, "نوع العقد"),
    (1, 110, 40, "Commencement date:"), (1, 110, 180, "{start}"), (1, 130, 40, "Contract end date:"), (1, 130, 180, "{end}"),
    (1, 150, 40, "2. First Party's Information"), (1, 170, 40, "Establishment name:"), (1, 170, 180, "Example Company"),
    (1, 190, 40, "3. Second Party's Information"), (1, 210, 40, "Employee name:"), (1, 210, 180, "Worker Name"),
    (1, 230, 40, "ID no:"), (1, 230, 180, "{idno}"), (1, 250, 40, "Nationality:"), (1, 250, 180, "{nat}"),
    (1, 270, 40, "5. Contract Period"), (1, 290, 40, "5.1 This contract is valid for a period of ({term}) months and is automatically"),
    (1, 304, 40, "renewed unless notice is given at least ({notice}) days before its end."), (1, 330, 40, "6. Probation"),
    (1, 350, 40, "6.1 There is a probationary period of ({prob}) days. The following"),
    (1, 364, 40, "do not count towards this period: Eid al-Fitr, sick leave and birthdays."), (1, 380, 40, "7. Work Hours"),
    (1, 400, 40, "7.1 The working days shall be ({wd}) days a week. The working hours shall be daily ({dh}) hours."),
    (1, 800, 40, "Page 1"), (2, 40, 40, "8. Annual Leave"), (2, 60, 40, "8.1 The employee gets a vacation of ({leave}) calendar days."),
    (2, 90, 40, "9. Wages and Benefits"), (2, 130, 40, "9.1.1 Basic wage:"), (2, 130, 180, "{basic}.00 Monthly"),
    (2, 150, 40, "Housing allowance:"), (2, 150, 180, "{housing}.00 Monthly"), (2, 170, 40, "Transportation"), (2, 170, 180, "{transport}.00 Monthly"),
    (2, 184, 40, "Allowance:"), (2, 210, 40, "Total wage:"), (2, 210, 180, "{total}.00 Monthly"),
    (2, 240, 40, "11. First Party's Obligations"), (2, 260, 40, "11.2 Overtime pays the hourly wage plus ({ot}%) of the basic hourly wage."),
    (2, 300, 40, "15. Additional Terms"), (2, 320, 40, "15.1 The probation may be renewed once."), (2, 322, 400, "يجوز تجديد التجربة"),
    (2, 334, 40, "It applies to all staff."), (2, 360, 40, "15.2 The employee keeps {prob} secrets."), (3, 40, 40, "15.3 Last term."),
    (3, 80, 40, "16. Appendix"), (3, 100, 40, "None."), (3, 800, 40, "Page 3"),
]
VALUES = {
    "type": "CASE c_custkey%3 WHEN 0 THEN 'Fixed-term Contract' WHEN 1 THEN 'Indefinite Contract' ELSE 'Casual work' END",
    "start": "concat('2024/', CAST(1+c_custkey%12 AS {s}), '/', CAST(1+c_custkey%28 AS {s}))",
    "end": "CASE WHEN c_custkey%3=0 THEN concat(CAST(1+c_custkey%28 AS {s}), '/', CAST(1+c_custkey%12 AS {s}), '/2025') ELSE '-' END",
    "idno": "CAST(1000000000+c_custkey AS {s})",
    "nat": "CASE WHEN c_custkey%2=0 THEN 'Saudi Arabia' ELSE 'Jordan' END",
    "term": "CAST(12*(1+c_custkey%3) AS {s})", "notice": "CAST(30+30*(c_custkey%2) AS {s})", "prob": "CAST(60+c_custkey%150 AS {s})",
    "wd": "CAST(5+c_custkey%2 AS {s})", "dh": "CAST(7+c_custkey%3 AS {s})", "leave": "CAST(14+c_custkey%20 AS {s})",
    "basic": "CAST(3000+(c_custkey%170)*100 AS {s})", "housing": "CAST(750+(c_custkey%170)*25 AS {s})", "transport": "CAST(300+(c_custkey%170)*10 AS {s})",
    "total": "CAST(4050+(c_custkey%170)*135+CASE WHEN c_custkey%29=0 THEN 500 ELSE 0 END AS {s})", "ot": "CAST(25*(1+c_custkey%3) AS {s})",
}


@view("contract_cells", ("customer",))
def _contract_cells(d: str) -> str:
    s = "STRING" if d == "spark" else "VARCHAR"

    def lit(text: str) -> str:
        if d == "spark":
            return "'" + text.replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"
        return "'" + text.replace("'", "''") + "'"

    rows = ",".join(f"({i},{p},{y},{x},{lit(t)})" for i, (p, y, x, t) in enumerate(CELLS))
    text = "t"
    for name, sql in VALUES.items():
        mark = "{{" + name + "}}" if d == "spark" else "{" + name + "}"
        text = f"replace({text}, '{mark}', {sql.format(s=s)})"
    return f"SELECT c_custkey AS doc_id, CAST(n AS INT) AS cell, CAST(p AS INT) AS page, CAST(y AS DOUBLE) AS y_min, CAST(x AS DOUBLE) AS x, {text} AS text FROM @customer@, (VALUES {rows}) v(n, p, y, x, t)"


@view("contract_words", (), ("contract_cells",))
def _contract_words(d: str) -> str:
    size = "CAST(595 AS DOUBLE) AS page_width, CAST(842 AS DOUBLE) AS page_height"
    if d == "spark":
        words = "SELECT doc_id, cell, page, y_min, x, ws, posexplode(ws) AS (i, text) FROM (SELECT *, split(text, ' ') AS ws FROM @contract_cells@)"
        before = "aggregate(slice(ws, 1, i), 0, (a, w) -> a + length(w) + 1)"
    else:
        words = "SELECT doc_id, cell, page, y_min, x, ws, unnest(ws) AS text, unnest(range(0, len(ws))) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM @contract_cells@)"
        before = "coalesce(list_sum([length(w)+1 FOR w IN ws[1:i]]), 0)"
    return f"""SELECT doc_id, page, {size}, cell, text, x + 3*{before} AS x_min, x + 3*{before} + 3*length(text) AS x_max, y_min, y_min + 12 AS y_max FROM ({words}) z"""


V = ("contract_cells",)
# Arabic cells are printed 2 pt below their row.
LOW = ",".join(str(i) for i, c in enumerate(CELLS) if c[2] == 400)
# Every row of the layout: cells of one page whose tops lie within 3 pt.
_ROWS = f", r AS (SELECT *, CASE WHEN cell IN ({LOW}) THEN y_min-2 ELSE y_min END row_y FROM contract_cells), ln AS (SELECT doc_id, page, row_y, string_agg(text, ' ' ORDER BY x) row_text, string_agg(text, ' ' ORDER BY x) FILTER (WHERE x<297.5) en_text, string_agg(text, ' ' ORDER BY x) FILTER (WHERE x>=297.5) ar_text, CAST(count(*) AS BIGINT) n, row_y>=782 footer FROM r GROUP BY 1,2,3)\n, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, row_y)-1 AS i FROM ln WHERE NOT footer)\n"


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_rows(load(spark, sf, "contract_words", heavy=True))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return layout.documents(text_rows(spark, sf))


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_fields(docs(spark, sf))


@query("layout_rows", oracle(("contract_words",), f", w AS (SELECT *, CASE WHEN cell IN ({LOW}) THEN y_min-2 ELSE y_min END row_y FROM contract_words) SELECT doc_id, page, row_y, CAST(count(*) AS BIGINT) AS words FROM w GROUP BY 1,2,3"))
def layout_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.with_rows(load(spark, sf, "contract_words", heavy=True))
    return rows.groupBy("doc_id", "page", "row_y").agg(F.count(F.lit(1)).alias("words"))


@query("layout_segments", oracle(V, _ROWS + "SELECT doc_id, page, row_y, text, x AS x_min, x + 3*length(text) AS x_max, CASE WHEN x<297.5 THEN 'en' ELSE 'ar' END AS \"column\" FROM r"))
def layout_segments(spark: SparkSession, sf: str) -> DataFrame:
    cells = layout.segments(layout.with_rows(load(spark, sf, "contract_words", heavy=True)))
    return cells.select("doc_id", "page", "row_y", "text", "x_min", "x_max", "column")


@query("layout_row_text", oracle(V, _ROWS + "SELECT doc_id, page, row_y, row_text, coalesce(en_text,'') AS en_text, coalesce(ar_text,'') AS ar_text FROM ln"))
def layout_row_text(spark: SparkSession, sf: str) -> DataFrame:
    return text_rows(spark, sf).select("doc_id", "page", "row_y", "row_text", "en_text", "ar_text")


@query("layout_footer", oracle(V, _ROWS + "SELECT doc_id, page, row_text FROM ln WHERE footer"))
def layout_footer(spark: SparkSession, sf: str) -> DataFrame:
    return text_rows(spark, sf).where("footer").select("doc_id", "page", "row_text")


_HEADS = "('contract_info','1. Contract Information'),('first_party','2. First Party''s Information'),('second_party','3. Second Party''s Information'),('period','5. Contract Period'),('probation','6. Probation'),('hours','7. Work Hours'),('leave','8. Annual Leave'),('wage','9. Wages and Benefits'),('first_obligations','11. First Party''s Obligations'),('additional','15. Additional Terms'),('appendix','16. Appendix')"
_SECT = f", sec AS (SELECT l.doc_id, h.key, string_split(en_text,'.')[1] AS number, CAST(i AS INTEGER) AS start, CAST(coalesce(lead(i) OVER (PARTITION BY l.doc_id ORDER BY i), (SELECT max(i)+1 FROM l m WHERE m.doc_id=l.doc_id)) AS INTEGER) AS \"end\" FROM l JOIN (VALUES {_HEADS}) h(key, title) ON l.en_text=h.title)\n"


@query("section_bounds", oracle(V, _ROWS + _SECT + 'SELECT doc_id, key, number, start, "end" FROM sec'))
def section_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.inline("sections")).drop("page")


_KEYS = ",".join(f"('{k}')" for k, _ in layout.SECTION_TITLES)


@query("section_text", oracle(V, _ROWS + _SECT + f"SELECT d.doc_id, k.key, coalesce(string_agg(l.en_text, ' ' ORDER BY l.i), '') AS text FROM (SELECT DISTINCT doc_id FROM ln) d CROSS JOIN (VALUES {_KEYS}) k(key) LEFT JOIN sec s ON s.doc_id=d.doc_id AND s.key=k.key LEFT JOIN l ON l.doc_id=d.doc_id AND (s.key IS NULL OR (l.i>s.start AND l.i<s.\"end\")) GROUP BY 1,2"))
def section_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every section of every contract; of one whose heading is missing the whole document."""
    return docs(spark, sf).select("doc_id", F.inline(layout.section_texts()))


_LABELS = {"contract type": 3, "commencement date": 6, "contract end date": 8, "establishment name": 11, "employee name": 14, "id no": 16, "nationality": 18, "basic wage": 32, "housing allowance": 34, "transportation allowance": 36, "total wage": 39}
_LABEL_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, text AS value, page FROM contract_cells WHERE cell={n}" for k, n in _LABELS.items())


@query("label_values", oracle(V, "SELECT * FROM (" + _LABEL_SQL + ")"))
def label_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", F.explode(extract.label_values()).alias("v"))
    return rows.select("doc_id", "v.label", "v.value", "v.page")


@query("label_lookup", oracle(V, "SELECT a.doc_id, a.text AS nationality, b.text AS basic FROM contract_cells a JOIN contract_cells b ON a.doc_id=b.doc_id WHERE a.cell=18 AND b.cell=32"))
def label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("labels", extract.label_values())
    return d.select(
        "doc_id", extract.find_label("^nationality$", "second_party")["value"].alias("nationality"),
        extract.find_label("^basic wage$", "wage")["value"].alias("basic"),
    )


@query(
    "extract_fields",
    """SELECT c_custkey AS doc_id, CASE c_custkey%3 WHEN 0 THEN 'fixed_term' WHEN 1 THEN 'indefinite' ELSE 'unknown' END AS contract_type, make_date(2024, CAST(1+c_custkey%12 AS BIGINT), CAST(1+c_custkey%28 AS BIGINT)) AS commencement_date,
 CASE WHEN c_custkey%3=0 THEN make_date(2025, CAST(1+c_custkey%12 AS BIGINT), CAST(1+c_custkey%28 AS BIGINT)) END AS end_date, CAST(12*(1+c_custkey%3) AS INTEGER) AS term_months, true AS auto_renew, CAST(30+30*(c_custkey%2) AS INTEGER) AS renewal_notice_days,
 CAST(60+c_custkey%150 AS INTEGER) AS probation_days, 'eid_al_fitr,sick_leave,other' AS excluded, CAST(5+c_custkey%2 AS DOUBLE) AS work_days, CAST(7+c_custkey%3 AS DOUBLE) AS daily_hours, CAST((7+c_custkey%3)*(5+c_custkey%2) AS DOUBLE) AS weekly_hours,
 CAST(14+c_custkey%20 AS INTEGER) AS annual_leave_days, CAST(25*(1+c_custkey%3) AS DOUBLE) AS overtime_premium_pct, CASE WHEN c_custkey%2=0 THEN 'saudi' ELSE 'non_saudi' END AS nationality, CAST(1000000000+c_custkey AS VARCHAR) AS employee_id, CAST(1 AS INTEGER) AS type_page, CAST(2 AS INTEGER) AS leave_page FROM customer""",
)
def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark, sf).select(
        "doc_id", "contract_type", "commencement_date", "end_date", "term_months", "auto_renew", "renewal_notice_days",
        "probation_days", F.array_join("probation_excluded_days", ",").alias("excluded"), F.col("work_days_per_week").alias("work_days"),
        "daily_hours", "weekly_hours", "annual_leave_days", "overtime_premium_pct", "nationality", "employee_id",
        F.col("pages")["contract_type"].alias("type_page"), F.col("pages")["annual_leave_days"].alias("leave_page"),
    )


@query(
    "wage_parts_check",
    """SELECT c_custkey AS doc_id, CAST(3000+(c_custkey%170)*100 AS DOUBLE) AS basic, CAST(750+(c_custkey%170)*25 AS DOUBLE) AS housing, CAST(300+(c_custkey%170)*10 AS DOUBLE) AS transport, CAST(4050+(c_custkey%170)*135+CASE WHEN c_custkey%29=0 THEN 500 ELSE 0 END AS DOUBLE) AS total,
 concat_ws(',', CASE WHEN c_custkey%3=2 THEN 'contract_type' END, CASE WHEN c_custkey%29=0 THEN 'wage' END, CASE WHEN c_custkey%3=2 THEN 'contract_type' END) AS issues, c_custkey%29=0 OR c_custkey%3=2 AS needs_review FROM customer""",
)
def wage_parts_check(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark, sf).select(
        "doc_id", *[F.col(f"wage.{c}").alias(c) for c in ("basic", "housing", "transport", "total")],
        F.array_join(F.transform("issues", lambda i: i["field"]), ",").alias("issues"), "needs_review",
    )


@query("clause_segment", """SELECT c_custkey AS doc_id, n AS number, sha256(lower(t)) AS text_hash, t AS text_en FROM customer, LATERAL (VALUES ('15.1','The probation may be renewed once. It applies to all staff.'),('15.2','The employee keeps ' || CAST(60+c_custkey%150 AS VARCHAR) || ' secrets.'),('15.3','Last term.')) v(n,t)""")
def clause_segment(spark: SparkSession, sf: str) -> DataFrame:
    return extract.clause_rows(extracted(spark, sf)).select("doc_id", "number", "text_hash", "text_en")


@query("section_regions", "SELECT c_custkey AS doc_id, CAST(page AS INTEGER) AS page, 297.5::DOUBLE AS x_min, CAST(y AS DOUBLE) AS y_min, 595::DOUBLE AS x_max, CAST(z AS DOUBLE) AS y_max FROM customer, (VALUES (2,314,780),(3,38,78)) v(page,y,z)")
def section_regions(spark: SparkSession, sf: str) -> DataFrame:
    return extract.arabic_regions(docs(spark, sf))


@query("clause_boxes", """SELECT c_custkey AS doc_id, clause, CAST(page AS INTEGER) AS page, CAST(a AS DOUBLE) AS y_min, CAST(b AS DOUBLE) AS y_max FROM customer, (VALUES ('1',1,70,142),('2',1,150,182),('3',1,190,262),('5',1,270,316),('5.1',1,290,316),('6',1,330,376),('6.1',1,350,376),('7',1,380,412),('7.1',1,400,412),
 ('8',2,40,72),('8.1',2,60,72),('9',2,90,222),('9.1',2,130,222),('9.1.1',2,130,222),('11',2,240,272),('11.2',2,260,272),('15',2,300,372),('15',3,40,52),('15.1',2,320,346),('15.2',2,360,372),('15.3',3,40,52),('16',3,80,112)) v(clause,page,a,b)""")
def clause_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return layout.clause_boxes(docs(spark, sf)).select("doc_id", "clause", "page", "y_min", "y_max")


@query("reading_order", """SELECT doc_id, clause, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y_min, length(clause), clause) AS INTEGER) AS place FROM (
SELECT c_custkey AS doc_id, clause, CAST(page AS INTEGER) AS page, CAST(a AS DOUBLE) AS y_min, CAST(b AS DOUBLE) AS y_max FROM customer, (VALUES ('1',1,70,142),('2',1,150,182),('3',1,190,262),('5',1,270,316),('5.1',1,290,316),('6',1,330,376),('6.1',1,350,376),('7',1,380,412),('7.1',1,400,412),
 ('8',2,40,72),('8.1',2,60,72),('9',2,90,222),('9.1',2,130,222),('9.1.1',2,130,222),('11',2,240,272),('11.2',2,260,272),('15',2,300,372),('15',3,40,52),('15.1',2,320,346),('15.2',2,360,372),('15.3',3,40,52),('16',3,80,112)) v(clause,page,a,b))""")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(*layout.reading_order(), "clause")
    return clause_boxes(spark, sf).select("doc_id", "clause", F.row_number().over(order).alias("place"))


@query("detect_document", "SELECT c_custkey AS doc_id, true AS ok, CAST(1 AS INTEGER) AS first_titled_page, CAST(NULL AS VARCHAR) AS reason FROM customer")
def detect_document(spark: SparkSession, sf: str) -> DataFrame:
    return layout.detect(text_rows(spark, sf))


@query("ocr_attach", """SELECT c_custkey AS doc_id, n AS number, t AS text_ar FROM customer, LATERAL (VALUES ('15.1','first ' || CAST(c_custkey AS VARCHAR)),('15.2','second more 9 lines'),('15.3',NULL)) v(n,t)""")
def ocr_attach(spark: SparkSession, sf: str) -> DataFrame:
    ocr = F.concat(F.lit("noise\n1 first "), F.col("doc_id").cast("string"), F.lit("\n٢.١٥ second\nmore\n9 lines"))
    d = extracted(spark, sf)
    return d.select("doc_id", F.inline(extract.attach_ocr(F.col("clauses"), ocr)))


@query("party_names", "SELECT c_custkey AS doc_id, t AS text, p AS placeholder FROM customer, (VALUES ('Example Company','[EMPLOYER]'),('Worker Name','[EMPLOYEE]')) v(t,p)")
def party_names(spark: SparkSession, sf: str) -> DataFrame:
    return extract.party_names(extracted(spark, sf)).select("doc_id", "text", "placeholder")


@query("rate_findings")
def rate_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Word boxes to findings through the whole plan; extraction and detectors have oracles of their own."""
    rating, _ = rate_layouts(load(spark, sf, "contract_words", heavy=True), RULES, "2024-06-01")
    return rating.findings.select("contract_id", "rule_id", "verdict", "severity")
