"""Clause readings, detectors and the type cross-check over the clause view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.quantities import percentages, quantities
from pactum.functions.text import normalise_english, split_sentences
from pactum.operators import clause_detectors as cd
from pactum.workload.clause_library import LIBRARY
from pactum.workload.common import RULES
from pactum.workload.registry import query
from pactum.workload.views import load, oracle

V = ("contract_clauses",)
NUMS = ", cc AS (SELECT *, 10+contract_id%200 n, 14+contract_id%20 m, 7+contract_id%3 h, 25*(1+contract_id%3) p, 6+contract_id%30 k, probation_days pd, CASE WHEN contract_id%10<6 THEN 'fixed_term' WHEN contract_id%10<9 THEN 'indefinite' END rec FROM contract_clauses)\n"


def _expected(only: str | None = None) -> str:
    parts = []
    for lib, (_, _, matches, _) in enumerate(LIBRARY):
        for rule, verdict, severity, confidence in matches:
            if only is None or rule == only:
                parts.append(
                    f"SELECT contract_id, clause, '{rule}' AS rule_id, {verdict} AS verdict, {severity} AS severity, {confidence} AS confidence FROM cc WHERE lib={lib} AND ({verdict}) IS NOT NULL"
                )
    return "(" + " UNION ALL ".join(parts) + ")"


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return cd.analyse_clauses(load(spark, sf, "contract_clauses", heavy=True), RULES)


def matches(df: DataFrame) -> DataFrame:
    return cd.match_rows(df, "contract_id", "clause")


_COLS = ("contract_id", "clause", "rule_id", "verdict", "severity", "confidence")


@query("clause_matches", oracle(V, NUMS + "SELECT * FROM " + _expected()))
def clause_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matches(analysed(spark, sf)).select(*_COLS)


def _detector(rule_id: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        only = {rule_id: cd.CLAUSE_DETECTORS[rule_id]}
        rows = cd.analyse_clauses(load(spark, sf, "contract_clauses", heavy=True), RULES, only)
        return matches(rows).select(*_COLS)

    return run


for _name, _rule in {
    "det_probation": "PROB-MAX-01", "det_leave_min": "LEAVE-MIN-01", "det_leave_forfeit": "LEAVE-FORFEIT-01",
    "det_hours": "HOURS-MAX-01", "det_eos_base": "EOS-BASE-01", "det_art77": "COMP-ART77-01",
    "det_overtime": "OT-RATE-01", "det_project_end": "TYPE-ART57-01", "det_transfer": "TRANSFER-KSA-01",
    "det_noncompete": "NONCOMPETE-01", "det_confidential": "CONFIDENTIAL-01",
}.items():
    query(_name, oracle(V, NUMS + "SELECT * FROM " + _expected(_rule)))(_detector(_rule))


STATED = "CASE lib " + " ".join(
    f"WHEN {i} THEN '{stated}'" for i, (_, _, _, stated) in enumerate(LIBRARY) if stated
) + " END"


def type_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.col("contract_id") % 10
    recorded = F.when(rest < 6, "fixed_term").when(rest < 9, "indefinite")
    return cd.type_conflicts(cd.state_types(load(spark, sf, "contract_clauses", heavy=True)), RULES, recorded)


@query(
    "cross_conflicts",
    oracle(V, NUMS + f""", st AS (SELECT *, {STATED} stated FROM cc)
SELECT contract_id, clause, 'TYPE-CONFLICT-01' AS rule_id, CASE WHEN rec='fixed_term' AND stated='specific_work' THEN '5.1' ELSE '1' END AS template_clause, 'high' AS severity, 'high' AS confidence
FROM st WHERE stated IS NOT NULL AND rec IS NOT NULL AND stated<>rec AND NOT (rec='fixed_term' AND stated='fixed_term')"""),
)
def cross_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return type_conflicts(spark, sf).select("contract_id", "clause", "rule_id", "template_clause", "severity", "confidence")


@query(
    "clause_nonempty",
    oracle(V, "SELECT contract_id, clause, trim(text_en)<>'' AS has_en, coalesce(trim(text_ar),'')<>'' AS has_ar FROM contract_clauses WHERE trim(text_en)<>'' OR coalesce(trim(text_ar),'')<>''"),
)
def clause_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    from pactum.operators.clause_analysis import with_text

    return with_text(load(spark, sf, "contract_clauses", heavy=True)).select(
        "contract_id", "clause", (F.trim("text_en") != "").alias("has_en"),
        (F.coalesce(F.trim("text_ar"), F.lit("")) != "").alias("has_ar"),
    )


@query(
    "clause_reading",
    oracle(V, """SELECT contract_id, clause, CASE WHEN text_en<>'' THEN 'high' ELSE 'medium' END AS max_confidence,
 CASE lib WHEN 21 THEN 'ت حسب' ELSE trim(regexp_replace(replace(lower(text_en), '’', ''''), '\\s+', ' ', 'g')) END AS reading FROM contract_clauses WHERE lib NOT IN (21,22)
UNION ALL SELECT contract_id, clause, 'medium', CASE lib WHEN 21 THEN 'end-of-service award on the basis of basic salary' ELSE 'transfer any of its branches within the kingdom' END FROM contract_clauses WHERE lib IN (21,22)"""),
)
def clause_reading(spark: SparkSession, sf: str) -> DataFrame:
    rows = cd.read_clauses(load(spark, sf, "contract_clauses", heavy=True))
    # The gloss leaves unknown Arabic words as they are; only its English words are compared.
    english = F.trim(F.regexp_replace(F.regexp_replace("text", "¤+|[.]$", " "), " +", " "))
    english = F.regexp_replace(english, "[ .]+$", "")
    reading = F.when(F.col("text_en") == "", english).otherwise(F.col("text"))
    return rows.select("contract_id", "clause", "max_confidence", reading.alias("reading"))


@query("gloss_ar")
def gloss_ar(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "contract_clauses", heavy=True).where("text_ar IS NOT NULL")
    gloss = normalise_english(cd.gloss_arabic(F.col("text_ar")), with_nfkc=False)
    return rows.select("contract_id", "clause", gloss.alias("gloss"))


@query(
    "sentences",
    # The oracle has no lookbehind: signs right after an abbreviation are set aside while it splits.
    """WITH t AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\b(art|arts|no|cl)[.]', '\\1' || chr(1), 'g') t FROM documents)
, u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\b(art|arts|no|cl)[;]', '\\1' || chr(2), 'g'), '\\b(art|arts|no|cl)[!]', '\\1' || chr(3), 'g') t FROM t)
, v AS (SELECT doc_id, regexp_replace(t, '\\b(art|arts|no|cl)[?]', '\\1' || chr(4), 'g') t FROM u)
, s AS (SELECT doc_id, [x FOR x IN [trim(translate(y, chr(1) || chr(2) || chr(3) || chr(4), '.;!?')) FOR y IN regexp_split_to_array(t, '[.;!?]+(?:\\s+|$)')] IF x<>''] p FROM v)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n, sha256(array_to_string(p, '|')) AS joined FROM s""",
)
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", heavy=True)
    s = docs.select("doc_id", split_sentences(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("p"))
    return s.select("doc_id", F.size("p").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("joined"))


_QTY = {
    0: [("n", "day")], 1: [("n", "day")], 3: [("m", "day")], 6: [("h", "hour"), ("6", "day")],
    11: [("2", "month")], 15: [("3", "year")], 16: [("k", "month")], 18: [("2", "year")],
    24: [("1", "year")], 27: [("90", "day"), ("60", "day"), ("15", "day")], 28: [("7", "hour")],
    29: [("21", "day"), ("25", "day"), ("5", "year")], 30: [("k", "month")],
}


@query(
    "quantities",
    oracle(V, NUMS + " UNION ALL ".join(
        f"SELECT contract_id, clause, {i + 1} AS qno, CAST({v} AS DOUBLE) AS value, '{u}' AS unit FROM cc WHERE lib={lib}"
        for lib, qs in _QTY.items() for i, (v, u) in enumerate(qs)
    )),
)
def quantities_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = cd.read_clauses(load(spark, sf, "contract_clauses", heavy=True))
    found = quantities(F.col("text"))
    out = rows.select("contract_id", "clause", F.posexplode(found).alias("i", "q"))
    return out.select("contract_id", "clause", (F.col("i") + 1).alias("qno"), "q.value", "q.unit")


@query("percentages", oracle(V, NUMS + "SELECT contract_id, clause, CAST(p AS DOUBLE) AS pct FROM cc WHERE lib=8"))
def percentages_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = cd.read_clauses(load(spark, sf, "contract_clauses", heavy=True))
    found = percentages(F.col("text"))
    return rows.select("contract_id", "clause", F.explode(found).alias("pct"))
