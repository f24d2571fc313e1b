"""Views the registered queries read, derived from the driver tables.

Each view is one SQL text with two dialects: Spark runs it over the parquet tables, and the
oracle puts it in front of its own query as a common table expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.session import table

# name -> (driver tables, view names it reads, sql(dialect))
_VIEWS: dict[str, tuple[tuple[str, ...], tuple[str, ...], Callable[[str], str]]] = {}


def view(name: str, tables: tuple[str, ...], uses: tuple[str, ...] = ()):
    def register(fn: Callable[[str], str]):
        _VIEWS[name] = (tables, uses, fn)
        return fn

    return register


#: A session of tests or benches names here how many partitions a CPU-bound query's table gets.
SCAN_PARTITIONS = "spark.pactum.scan.partitions"
#: By which key a CPU-bound query's table is dealt out, and about how many rows a partition gets.
DEALT = {
    "customer": ("c_custkey", 1_000), "documents": ("doc_id", 2_000), "orders": ("o_orderkey", 10_000),
    "lineitem": ("l_orderkey", 50_000), "events": ("user_id", 50_000),
}

#: Columns of views with so many replacements that the generated method of their stage is larger than the JVM compiles
#: (8,000 bytes), so that it runs interpreted. A lambda around the same expression keeps it out of that method. It comes as
#: the one element of an exploded array, so that no filter on what is made of it moves below it and computes it again.
APART = {"contract_cells": "text"}


def _parts(df: DataFrame, rows: int) -> int:
    spark = df.sparkSession
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return int(wanted) if wanted else max(spark.sparkContext.defaultParallelism, -(-df.count() // rows))


def together(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """A number of partitions for tables that meet by the keys of :data:`DEALT`: dealt out alike, they need no further shuffle."""
    return max(_parts(table(spark, sf_dir, n), DEALT[n][1]) for n in names)


def _dealt(df: DataFrame, name: str, parts: int | None) -> DataFrame:
    """The table by its key in partitions of a bounded number of rows.

    A file may be one split however large it is, and views make hundreds of rows of one. The number of rows comes from
    the file's footer. What groups by the key afterwards needs no further shuffle.
    """
    if name not in DEALT:
        return df
    key, rows = DEALT[name]
    return df.repartition(parts or _parts(df, rows), key)


def load(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False, parts: int | None = None) -> DataFrame:
    """The view as a lazy DataFrame (a driver table when no view has that name).

    ``heavy``: the work on the view is CPU-bound, so its tables are dealt out (:data:`DEALT`). ``parts``: they are dealt
    out in so many partitions (:func:`together`).
    """
    if name not in _VIEWS:
        df = table(spark, sf_dir, name)
        return _dealt(df, name, parts) if heavy or parts else df
    tables, uses, fn = _VIEWS[name]
    inputs = {t: load(spark, sf_dir, t, heavy, parts) for t in (*tables, *uses)}
    sql = fn("spark")
    for t in inputs:
        sql = sql.replace(f"@{t}@", "{" + t + "}")
    df = spark.sql(sql, **inputs)
    return df.withColumn(APART[name], F.explode(F.transform(F.array(APART[name]), lambda x: x))) if name in APART else df


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the oracle, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in _VIEWS:
            return
        for dep in _VIEWS[name][1]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        tables, uses, fn = _VIEWS[name]
        sql = fn("duckdb")
        for t in (*tables, *uses):
            sql = sql.replace(f"@{t}@", t)
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n"


def oracle(names: tuple[str, ...], body: str) -> str:
    """The body may start with further common table expressions (``, x AS (...) SELECT``)."""
    return with_views(*names).rstrip() + "\n" + body


# --- wages -------------------------------------------------------------------------------


@view("contract_wages", ("customer",))
def _contract_wages(d: str) -> str:
    return """SELECT c_custkey AS employee_id, c_name AS name, b AS basic, h AS housing, t AS transport, b+h+t AS total FROM
 (SELECT c_custkey, c_name, CAST(3000+(c_custkey%170)*100 AS BIGINT) b, CAST(750+(c_custkey%170)*25 AS BIGINT) h, CAST(300+(c_custkey%170)*10 AS BIGINT) t
    FROM @customer@ WHERE c_custkey%41<>0
  UNION ALL
  SELECT c_custkey, c_name, CAST(2000 AS BIGINT), CAST(500 AS BIGINT), CAST(200 AS BIGINT) FROM @customer@ WHERE c_custkey%53=1) x"""


@view("payroll_wages", ("customer",))
def _payroll_wages(d: str) -> str:
    return """SELECT c_custkey AS employee_id, c_name AS name, b AS basic, h AS housing, t AS transport, b+h+t AS total FROM
 (SELECT c_custkey, c_name,
   CAST(3000+(c_custkey%170)*100-CASE WHEN c_custkey%10=1 THEN 1000 WHEN c_custkey%10=4 THEN 250 ELSE 0 END AS BIGINT) b,
   CAST(CASE WHEN c_custkey%10=2 THEN 0 ELSE 750+(c_custkey%170)*25 END AS BIGINT) h,
   CAST(300+(c_custkey%170)*10+CASE WHEN c_custkey%10=1 THEN 1000 WHEN c_custkey%10=3 THEN 1250 ELSE 0 END AS BIGINT) t
  FROM @customer@ WHERE c_custkey%37<>0) x"""


@view("offer_wages", ("customer",))
def _offer_wages(d: str) -> str:
    return """SELECT c_custkey AS employee_id, c_name AS name, CAST(NULL AS BIGINT) AS basic, CAST(NULL AS BIGINT) AS housing, CAST(NULL AS BIGINT) AS transport,
 CAST(3000+(c_custkey%170)*100+750+(c_custkey%170)*25+300+(c_custkey%170)*10+CASE WHEN c_custkey%9=0 THEN 850 ELSE 0 END AS BIGINT) AS total
FROM @customer@ WHERE c_custkey%3=0"""


# --- contract fields ---------------------------------------------------------------------


@view("contract_fields", ("orders",))
def _contract_fields(d: str) -> str:
    months = "CAST(12*(1+o_orderkey%3) AS INT)"
    if d == "spark":
        end = f"date_sub(add_months(CAST(o_orderdate AS DATE), {months}), 1)"
    else:
        end = f"CAST(CAST(CAST(o_orderdate AS DATE)+to_months({months}) AS DATE)-1 AS DATE)"
    return f"""SELECT *, basic+housing+transport+other AS total FROM (
SELECT o_orderkey AS contract_id, o_custkey AS user_id,
 CASE WHEN o_orderkey%10<6 THEN 'fixed_term' WHEN o_orderkey%10<9 THEN 'indefinite' ELSE 'unknown' END AS contract_type,
 CAST(o_orderdate AS DATE) AS commencement_date, CASE WHEN o_orderkey%10<6 THEN {end} END AS end_date,
 CASE WHEN o_orderkey%10<6 AND o_orderkey%17<>0 THEN {months} END AS term_months,
 CASE WHEN o_orderkey%11=0 THEN NULL ELSE o_orderkey%2=0 END AS auto_renew,
 CAST(CASE WHEN o_orderkey%4=0 THEN 60 ELSE 30 END AS INT) AS renewal_notice_days,
 CAST(CASE o_orderkey%6 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 WHEN 3 THEN 210 WHEN 4 THEN 60 END AS INT) AS probation_days,
 CASE o_orderkey%5 WHEN 0 THEN '' WHEN 1 THEN 'eid_al_fitr,eid_al_adha' WHEN 2 THEN 'national_day,other' WHEN 3 THEN 'sick_leave' ELSE 'other' END AS excluded_days,
 CAST(CASE WHEN o_orderkey%19=0 THEN NULL ELSE 14+o_orderkey%20 END AS INT) AS annual_leave_days,
 CAST(CASE WHEN o_orderkey%7=0 THEN NULL ELSE 7+o_orderkey%3 END AS INT) AS daily_hours,
 CAST(CASE WHEN o_orderkey%13=0 THEN 40+o_orderkey%12 END AS INT) AS weekly_hours,
 CAST(5+o_orderkey%2 AS INT) AS work_days_per_week,
 CAST(2-o_orderkey%2 AS INT) AS rest_days_per_week,
 CAST(25*(1+o_orderkey%3) AS INT) AS overtime_premium_pct,
 CASE WHEN o_custkey%2=0 THEN 'saudi' ELSE 'non_saudi' END AS nationality,
 CAST(CASE WHEN o_orderkey%23=0 THEN NULL ELSE 3000+(o_custkey%170)*100 END AS BIGINT) AS basic,
 CAST((30+o_custkey%170)*(15+o_orderkey%20) AS BIGINT) AS housing,
 CAST((30+o_custkey%170)*(5+o_orderkey%10) AS BIGINT) AS transport,
 CAST(CASE WHEN o_orderkey%8=0 THEN 500 ELSE 0 END AS BIGINT) AS other
FROM @orders@) f"""


TODAY = "1998-06-01"


# --- findings, places --------------------------------------------------------------------

_FINDING_RULES = """(VALUES
 (0,'PROB-MAX-01','field','legal',NULL,'6.1'),(1,'PROB-EXCL-01','field','legal',NULL,'6.1'),(2,'PROB-NOCOMP-01','info','legal',NULL,'6.2'),
 (3,'LEAVE-MIN-01','field','legal','leave_value','8.1'),(4,'LEAVE-FORFEIT-01','clause','legal',NULL,NULL),(5,'HOURS-MAX-01','field','legal',NULL,'7'),
 (6,'OT-RATE-01','field','legal',NULL,'11.2'),(7,'EOS-BASE-01','clause','legal','eos_gap',NULL),(8,'COMP-ART77-01','clause','market','art77_gap',NULL),
 (9,'TYPE-CONFLICT-01','cross','legal,clarity',NULL,NULL),(10,'TYPE-ART57-01','clause','clarity',NULL,NULL),(11,'RENEW-CONVERT-01','info','legal',NULL,'5.1'),
 (12,'REVIEW-00','clause','clarity',NULL,NULL),(13,'NOTICE-INDEF-01','info','legal',NULL,NULL),(14,'TRANSFER-KSA-01','clause','market',NULL,NULL),
 (15,'NONCOMPETE-01','clause','legal',NULL,NULL),(16,'CONFIDENTIAL-01','clause','clarity',NULL,NULL),(17,'SETTLE-TIME-01','info','legal',NULL,NULL),
 (18,'MARKET-ALLOW-01','market','market',NULL,'9.1.1')) r(n, rule_id, kind, categories, impact_kind, template_clause)"""


@view("finding_rows", ("lineitem",))
def _finding_rows(d: str) -> str:
    return f"""SELECT contract_id, position, rule_id, source, clause, related_clause, categories, impact_kind, needs_review, eos_base, comp_months, comp_base, verdict,
 CASE WHEN rule_id='REVIEW-00' THEN 'low' WHEN verdict IN ('compliant','better_than_law') THEN 'none' WHEN sk%3=0 THEN 'high' WHEN sk%3=1 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT l_orderkey AS contract_id, CAST(l_linenumber AS BIGINT)*1000000000000000 + l_partkey*100000 + l_suppkey AS position, rule_id, l_suppkey AS sk,
 CASE WHEN kind='info' THEN 'info' WHEN kind='market' THEN 'market' WHEN kind='cross' THEN 'cross_check' WHEN kind='clause' OR l_suppkey%4=0 THEN 'clause' ELSE 'field_rule' END AS source,
 CASE WHEN kind IN ('clause','cross') OR (kind='field' AND l_suppkey%4=0) THEN concat('15.', CAST(1+l_partkey%9 AS {'STRING' if d == 'spark' else 'VARCHAR'})) ELSE template_clause END AS clause,
 CASE WHEN kind='cross' THEN CASE WHEN l_suppkey%2=0 THEN '5.1' ELSE '1' END END AS related_clause,
 categories, impact_kind, rule_id='REVIEW-00' AS needs_review,
 CASE WHEN l_suppkey%3=0 THEN 'basic' WHEN l_suppkey%3=1 THEN 'actual' ELSE 'other' END AS eos_base,
 CAST(CASE WHEN l_suppkey%7<6 THEN 1+l_partkey%30 END AS DOUBLE) AS comp_months,
 CASE WHEN l_partkey%2=0 THEN 'basic' ELSE 'actual' END AS comp_base,
 CASE WHEN kind='info' THEN 'compliant' WHEN kind='cross' THEN 'conflict' WHEN rule_id='REVIEW-00' THEN 'unclear' WHEN l_suppkey%5=0 THEN 'likely_void' WHEN l_suppkey%5=1 THEN 'worse_than_default'
  WHEN l_suppkey%5=2 THEN 'compliant' WHEN l_suppkey%5=3 THEN 'better_than_law' ELSE 'unclear' END AS verdict
 FROM @lineitem@ JOIN {_FINDING_RULES} ON l_partkey%19 = n) x"""


_PLACES = """(VALUES
 ('1',1,60.0,120.0,0),('5',2,80.0,200.0,0),('5.1',2,110.0,190.0,0),('6',2,210.0,280.0,0),('6.1',2,230.0,280.0,0),('7',3,60.0,140.0,0),
 ('8',3,150.0,210.0,0),('8.1',3,170.0,210.0,0),('9',3,220.0,400.0,0),('9.1',3,240.0,400.0,0),('9.1.1',3,250.0,400.0,0),('11',4,60.0,300.0,0),
 ('15',5,60.0,780.0,0),('15',6,60.0,300.0,0),('15.1',5,90.0,140.0,0),('15.2',5,150.0,200.0,0),('15.3',5,210.0,300.0,0),('15.4',5,310.0,780.0,0),
 ('15.4',6,60.0,90.0,0),('15.5',6,100.0,150.0,1),('15.6',6,160.0,200.0,2)) v(clause, page, y_min, y_max, skip_mod)"""


@view("clause_locations", ("orders",))
def _clause_locations(d: str) -> str:
    return f"""SELECT o_orderkey AS contract_id, clause, CAST(page AS INT) AS page, CAST(595.92 AS DOUBLE) AS page_width, CAST(842.04 AS DOUBLE) AS page_height, CAST(40 AS DOUBLE) AS x_min,
 CAST(y_min AS DOUBLE) + CAST(o_orderkey%7 AS DOUBLE) AS y_min, CAST(555 AS DOUBLE) AS x_max, CAST(y_max AS DOUBLE) + CAST(o_orderkey%7 AS DOUBLE) AS y_max
FROM @orders@, {_PLACES} WHERE skip_mod=0 OR o_orderkey%3<>skip_mod"""


@view("clause_texts", ("orders",))
def _clause_texts(d: str) -> str:
    s = "STRING" if d == "spark" else "VARCHAR"
    return f"""SELECT o_orderkey AS contract_id, concat('15.', CAST(k AS {s})) AS clause, concat('Term ', CAST(k AS {s}), ' of ', o_orderpriority) AS text_en,
 CASE WHEN o_orderkey%2=0 THEN concat('بند ', CAST(k AS {s})) END AS text_ar FROM @orders@, (VALUES (1),(2),(3),(4),(5),(6)) c(k)"""


# --- operations --------------------------------------------------------------------------


@view("audit_events", ("events",))
def _audit_events(d: str) -> str:
    return """SELECT event_id, ts AS at, user_id, CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'view'
 WHEN 'click' THEN 'view_document' WHEN 'purchase' THEN 'download' ELSE 'delete' END AS action FROM @events@"""


@view("rating_rows", ("events",))
def _rating_rows(d: str) -> str:
    start = (
        "ts + make_dt_interval(0,0,CAST(event_id%97 AS INT),0)"
        if d == "spark"
        else "ts + to_minutes(CAST(event_id%97 AS BIGINT))"
    )
    return f"""SELECT event_id AS rating_id, user_id, CASE event_id%6 WHEN 0 THEN 'queued' WHEN 1 THEN 'extracting' WHEN 2 THEN 'analysing'
 WHEN 3 THEN 'done' WHEN 4 THEN 'needs_review' ELSE 'failed' END AS status, ts AS created_at,
 CASE WHEN event_id%6>0 THEN {start} END AS started_at,
 CAST(CASE WHEN event_id%6 IN (3,4) THEN 30+event_id%71 END AS INT) AS score_overall FROM @events@"""


@view("stored_documents", ("events",))
def _stored_documents(d: str) -> str:
    due = "ts + make_dt_interval(30,0,0,0)" if d == "spark" else "ts + to_days(30)"
    return f"""SELECT event_id AS document_id, user_id, ts AS created_at, {due} AS delete_after,
 CASE WHEN event_id%5=0 THEN {due} END AS deleted_at, CAST(1+event_id%9 AS INT) AS pages FROM @events@ WHERE event_type='signup'"""


# --- clauses -----------------------------------------------------------------------------


def _filled(text: str, s: str) -> str:
    for name, value in (
        ("n", "10+o_orderkey%200"), ("m", "14+o_orderkey%20"), ("h", "7+o_orderkey%3"),
        ("p", "25*(1+o_orderkey%3)"), ("k", "6+o_orderkey%30"),
    ):
        text = f"replace({text}, '{{{name}}}', CAST({value} AS {s}))"
    return text


@view("contract_clauses", ("orders",))
def _contract_clauses(d: str) -> str:
    from pactum.workload.clause_library import LIBRARY

    s = "STRING" if d == "spark" else "VARCHAR"

    def lit(text: str | None) -> str:
        if text is None:
            return "NULL"
        if d == "spark":
            text = text.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")
            return f"'{text}'"
        return "'" + text.replace("'", "''") + "'"

    rows = ",\n".join(f"({i},{lit(en)},{lit(ar)})" for i, (en, ar, _, _) in enumerate(LIBRARY))
    filled = _filled("en", s)
    if d == "spark":
        filled = filled.replace("{", "{{").replace("}", "}}")
    picks = (
        "SELECT o_orderkey, explode(array(1,2,3,4,5)) AS j FROM @orders@"
        if d == "spark"
        else "SELECT o_orderkey, j FROM @orders@, (VALUES (1),(2),(3),(4),(5)) c(j)"
    )
    return f"""SELECT o_orderkey AS contract_id, concat('15.', CAST(j AS {s})) AS clause, CAST(lib AS INT) AS lib, {filled} AS text_en, CAST(ar AS {s}) AS text_ar,
 CAST(CASE o_orderkey%6 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 WHEN 3 THEN 210 WHEN 4 THEN 60 END AS INT) AS probation_days
FROM ({picks}) x JOIN (VALUES {rows}) l(lib, en, ar) ON (o_orderkey*7+j*3)%{len(LIBRARY)} = lib"""
