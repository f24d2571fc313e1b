"""Source and sink queries: file texts are derived from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.redaction import pattern_counts, redact_clauses, redact_patterns, redact_text, redaction_context
from pactum.functions.text import clause_hash
from pactum.operators import analyser
from pactum.operators import clause_analysis as ca

from pactum.sources import layouts, tables, wage_files
from pactum.workload import q_clauses
from pactum.workload.common import RULES
import pactum.workload.q_law  # noqa: F401  (defines the corpus view)
from pactum.workload.registry import query
from pactum.workload.views import load, oracle

_WORDS = "WITH w AS (SELECT doc_id, i, string_split(line,' ') ws FROM (SELECT doc_id, unnest(string_split(text,chr(10))) line, generate_subscripts(string_split(text,chr(10)),1) i FROM documents)) SELECT doc_id, CAST(i AS INTEGER) AS page, CAST(count(*) AS BIGINT) AS words, sha256(string_agg(trim(x), ' ' ORDER BY n)) AS joined FROM (SELECT doc_id, i, unnest(ws) x, generate_subscripts(ws,1) n FROM w) WHERE trim(x)<>'' GROUP BY 1,2"


def _page_facts(words: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("word_no", "text")))
    return words.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("words"),
        F.sha2(F.array_join(F.transform(ordered, lambda x: x["text"]), " "), 256).alias("joined"),
    )


@query("src_layout_words", _WORDS)
def src_layout_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", heavy=True)
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&#39;"))
    tag = '<word xMin="1" yMin="2" xMax="3" yMax="4">'
    page = lambda line: F.concat(
        F.lit(f'<page width="595" height="842">{tag}'), F.replace(line, F.lit(" "), F.lit(f"</word>\n{tag}")), F.lit("</word></page>")
    )
    files = docs.select("doc_id", F.array_join(F.transform(F.split(escaped, "\n"), page), "\n").alias("content"))
    # Pages are gathered, not words; a page of two files with one id is united.
    pages = layouts.layout_pages(files).groupBy("doc_id", "page").agg(F.flatten(F.collect_list("words")).alias("words"))
    texts = F.transform(F.sort_array("words"), lambda w: w["text"])
    return pages.where("size(words) > 0").select(
        "doc_id", "page", F.size("words").cast("long").alias("words"), F.sha2(F.array_join(texts, " "), 256).alias("joined")
    )


@query("src_ocr_tsv", _WORDS)
def src_ocr_tsv(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", heavy=True)
    row = lambda level, page, text: F.concat_ws("\t", F.lit(level), page.cast("string"), F.lit("0\t0\t0\t0\t10\t20\t300\t40\t90"), text)
    page = lambda line, i: F.concat_ws(
        "\n", row("1", i + 1, F.lit("")), row("4", i + 1, F.lit("")),
        F.array_join(F.transform(F.split(F.replace(line, F.lit("\t"), F.lit(" ")), " "), lambda w: row("5", i + 1, w)), "\n"),
    )
    files = docs.select("doc_id", F.concat(F.lit("header\n"), F.array_join(F.transform(F.split("text", "\n"), page), "\n")).alias("content"))
    return _page_facts(layouts.ocr_words(files, 300))


def _payroll_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A file per nation: title lines, a header (Arabic in odd nations), one line per customer."""
    nations = load(spark, sf, "nation")
    file = F.col("n_nationkey")
    arabic = "رقم الهوية,اسم الموظف,الراتب الأساسي,بدل السكن,البدلات الأخرى"
    english = '﻿employee id,"Employee_Name",BasicSalary,Housing Allowance,OtherAllowances'
    head = nations.select(
        file.alias("file"),
        F.posexplode(F.array(F.concat(F.lit("Payroll of "), F.col("n_name")), F.lit(",,,,"), F.when(file % 2 == 1, arabic).otherwise(english))).alias("pos", "line"),
    )
    c = load(spark, sf, "customer")
    key = F.col("c_custkey")
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit(', Mr"'))
    basic = F.when(key % 7 == 0, '"6,500"').when(key % 7 == 1, "٦٬٥٠٠").when(key % 7 == 2, "").otherwise((3000 + key % 100).cast("string"))
    body = c.select(
        F.col("c_nationkey").alias("file"), (key + 10).cast("int").alias("pos"),
        F.concat_ws(",", F.when(key % 31 == 0, "").otherwise(key.cast("string")), name, basic, F.lit("700"), F.when(key % 17 == 0, "x1").otherwise("300.5")).alias("line"),
    )
    return head.unionByName(body)


_PAY = """SELECT c_custkey AS k, CAST(c_nationkey AS INTEGER) AS file, CASE WHEN c_custkey%31=0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS employee_id, c_name || ', Mr' AS name,
 CAST(CASE c_custkey%7 WHEN 0 THEN 6500 WHEN 1 THEN 6500 WHEN 2 THEN 0 ELSE 3000+c_custkey%100 END AS DOUBLE) AS basic, c_custkey%17=0 AS bad FROM customer"""


@query("src_payroll_csv", f"SELECT file, employee_id, name, basic, 700::DOUBLE AS housing, 300.5::DOUBLE AS transport, basic+1000.5 AS total FROM ({_PAY}) WHERE employee_id IS NOT NULL AND NOT bad")
def src_payroll_csv(spark: SparkSession, sf: str) -> DataFrame:
    paid, _, _ = wage_files.read_payroll(_payroll_lines(spark, sf))
    return paid.select("file", "employee_id", "name", "basic", "housing", "transport", "total")


@query("src_payroll_rejects", f"SELECT file, CASE WHEN employee_id IS NULL THEN 'A row has no EmployeeID' ELSE 'OtherAllowances \"x1\" is not a number.' END AS error, CAST(count(*) AS BIGINT) AS n FROM ({_PAY}) WHERE employee_id IS NULL OR bad GROUP BY 1,2")
def src_payroll_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected, _ = wage_files.read_payroll(_payroll_lines(spark, sf))
    return rejected.groupBy("file", F.regexp_replace("error", ": .*", "").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("src_header_resolve", "SELECT CAST(n_nationkey AS INTEGER) AS file, CAST(2 AS INTEGER) AS header_pos, 'EmployeeID,EmployeeName,BasicSalary,HousingAllowance,OtherAllowances' AS header FROM nation")
def src_header_resolve(spark: SparkSession, sf: str) -> DataFrame:
    found = wage_files.headers(_payroll_lines(spark, sf), wage_files.PAYROLL_COLUMNS)
    return found.select("file", "header_pos", F.array_join("header", ",").alias("header"))


@query("src_contract_csv", "SELECT CASE WHEN c_custkey%3=0 THEN 'offer' WHEN c_custkey%3=1 THEN 'contract' ELSE 'reject' END AS kind, CAST(c_nationkey AS INTEGER) AS file, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN c_custkey%3<2 THEN 4000+c_custkey%50 END) AS DOUBLE) AS total FROM customer GROUP BY 1,2")
def src_contract_csv(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    head = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("file"), F.lit(0).alias("pos"),
        F.lit("EmployeeID,EmployeeName,Nationality,Source,BasicSalary,HousingAllowance,TransportAllowance,TotalWage").alias("line"),
    )
    source = F.when(key % 3 == 0, "offline").when(key % 3 == 1, "Qiwa").otherwise("other")
    body = load(spark, sf, "customer").select(
        F.col("c_nationkey").alias("file"), (key + 10).cast("int").alias("pos"),
        F.concat_ws(",", key.cast("string"), F.col("c_name"), F.lit("x"), source, F.lit("3000"), F.lit(""), F.lit("300"), (4000 + key % 50).cast("string")).alias("line"),
    )
    contracts, offers, rejected, _ = wage_files.read_contracts(head.unionByName(body))
    pick = lambda df, kind, t: df.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(t).cast("double").alias("total")).withColumn("kind", F.lit(kind))
    return pick(contracts, "contract", "total").unionByName(pick(offers, "offer", "total")).unionByName(pick(rejected, "reject", F.lit(None).cast("double")))


@query("src_wage_json", "SELECT CASE WHEN c_custkey%9=0 THEN NULL ELSE CAST(1000000000+c_custkey AS VARCHAR) END AS employee_id, c_name AS name, CASE WHEN c_custkey%4=0 THEN NULL ELSE CAST(3000+c_custkey%100 AS DOUBLE) END AS basic, CASE WHEN c_custkey%4=1 THEN 9000.5::DOUBLE END AS total FROM customer WHERE c_custkey%9<>0 AND c_custkey%11<>0")
def src_wage_json(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    text = F.concat(
        F.lit('{"employeeId":"'), F.when(key % 9 == 0, "12").otherwise((1000000000 + key).cast("string")), F.lit('","name":"'), F.col("c_name"), F.lit('","basic":'),
        F.when(key % 4 == 0, "null").otherwise(F.concat(F.lit('"'), (3000 + key % 100).cast("string"), F.lit('.00"'))),
        F.when(key % 4 == 1, ',"total":9000.5').when(key % 11 == 0, ',"total":-4').otherwise(""), F.when((key % 11 == 0) & (key % 4 == 1), ',"housing":-1').otherwise(""), F.lit("}"),
    )
    good, _ = wage_files.json_records(load(spark, sf, "customer").select(text.alias("value")))
    return good.select("employee_id", "name", "basic", "total")


@query("sink_replace_by_rating", oracle(("finding_rows",), "SELECT contract_id AS rating_id, position, 'old' AS batch FROM finding_rows WHERE NOT (contract_id%3=0 AND contract_id%5<>0) UNION ALL SELECT contract_id, position, 'new' FROM finding_rows WHERE contract_id%3=0 AND contract_id%5<>0 AND position%2=0 UNION ALL SELECT contract_id, position, 'old' FROM finding_rows WHERE contract_id%3=0 AND contract_id%5<>0 AND contract_id NOT IN (SELECT contract_id FROM finding_rows WHERE position%2=0)"))
def sink_replace_by_rating(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "finding_rows").select(F.col("contract_id").alias("rating_id"), "position")
    new = rows.where("rating_id % 3 = 0 AND position % 2 = 0").withColumn("batch", F.lit("new"))
    live = rows.select("rating_id").where("rating_id % 5 <> 0")
    return tables.replace_by_key(rows.withColumn("batch", F.lit("old")), new, live)


@query("sink_corpus_upsert", oracle(("corpus_rows",), "SELECT doc_id AS id, CASE WHEN doc_id%5=0 THEN 'removed' ELSE 'upserted' END AS change FROM corpus_rows WHERE law_version='2025-11'"))
def sink_corpus_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "corpus_rows").select(F.col("doc_id").alias("id"), "law_version", "text_en")
    new = old.where("law_version = '2025-11' AND id % 5 <> 0")
    _, changes = tables.upsert_corpus(old, new)
    return changes


@query("sink_cache_upsert", "SELECT CAST(user_id AS VARCHAR) AS cache_key, max(event_id) AS created_at, CAST(max(event_id) AS VARCHAR) AS result FROM events GROUP BY 1")
def sink_cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").alias("created_at"), F.col("event_id").cast("string").alias("result"))
    return tables.upsert_latest(rows.where("created_at % 2 = 0"), rows.where("created_at % 2 = 1"), ["cache_key"])


@query("audit_append", oracle(("audit_events",), "SELECT action, CAST(count(*) AS BIGINT) AS n FROM audit_events GROUP BY 1"))
def audit_append(spark: SparkSession, sf: str) -> DataFrame:
    from pactum.session import checkpoint_root
    import uuid

    path = f"{checkpoint_root(spark)}/audit-{uuid.uuid4().hex}"
    events = load(spark, sf, "audit_events")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        tables.append_audit(events.where(part), path)
    return spark.read.schema(events.schema).parquet(path).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# --- redaction, hashes, cache ------------------------------------------------------------


@query("redact_email", "SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS redacted, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS INTEGER) AS n FROM documents")
def redact_email(spark: SparkSession, sf: str) -> DataFrame:
    from pactum.functions.redaction import PATTERNS

    _, pattern, placeholder = PATTERNS[0]
    docs = load(spark, sf, "documents", heavy=True)
    return docs.select("doc_id", F.sha2(F.regexp_replace("text", pattern, placeholder), 256).alias("redacted"), F.regexp_count("text", F.lit(pattern)).alias("n"))


_R = "t"
for _pattern, _mark in (
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[EMAIL]"),
    ("\\b[Ss][Aa][-\\s]{0,3}(?:[0-9][-\\s]{0,3}){11,21}[0-9]", "[IBAN]"),
):
    _R = f"regexp_replace({_R}, '{_pattern}', '{_mark}', 'g')"
for _pattern, _mark in (
    ("(^|[^0-9])(?:(?:\\+|00)[-\\s]{0,3})?966(?:[-\\s]{0,3}[0-9]){8,9}([^0-9]|$)", "\\1[PHONE]\\2"),
    ("(^|[^0-9])0[-\\s]{0,3}5(?:[-\\s]{0,3}[0-9]){8}([^0-9]|$)", "\\1[PHONE]\\2"),
    ("(^|[^0-9])[127][0-9]{9}([^0-9]|$)", "\\1[ID]\\2"),
):
    for _ in range(2):  # RE2 has no lookaround: neighbours share their separator
        _R = f"regexp_replace({_R}, '{_pattern}', '{_mark}', 'g')"


@query("redact_patterns", f"SELECT doc_id, sha256({_R}) AS redacted FROM (SELECT doc_id, text AS t FROM documents)")
def redact_patterns_query(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents", heavy=True).select("doc_id", F.sha2(redact_patterns(F.col("text")), 256).alias("redacted"))


@query("redact_counts")
def redact_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents", heavy=True).select("doc_id", *pattern_counts(F.col("text")))


@query("redact_names")
def redact_names(spark: SparkSession, sf: str) -> DataFrame:
    """The first two words of a document stand for a name in it."""
    docs = load(spark, sf, "documents", heavy=True)
    name = F.regexp_extract("text", r"^\s*(\p{L}+\s+\p{L}+)", 1)
    names = docs.select("doc_id", F.lit(0).alias("order"), name.alias("text"), F.lit("[EMPLOYEE]").alias("placeholder"))
    joined = docs.join(redaction_context(names), "doc_id", "left")
    redacted = redact_text(F.col("text"), F.col("names"))
    return joined.select("doc_id", F.length(redacted).alias("n"), F.regexp_count(redacted, F.lit(r"\[EMPLOYEE\]")).alias("hits"))


@query("clause_hash", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS text_hash FROM documents")
def clause_hash_query(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents", heavy=True).select("doc_id", clause_hash(F.col("text")).alias("text_hash"))


_KEY = ", kk AS (SELECT contract_id, clause, lib, probation_days, sha256('[\"' || sha256(trim(regexp_replace(lower(text_en), '\\s+', ' ', 'g'))) || '\",' || CASE WHEN text_ar IS NULL THEN 'null' ELSE '\"' || text_ar || '\"' END || ',\"Probation: ' || coalesce(CAST(probation_days AS VARCHAR),'-') || '\"]') || '|2025-11|0.1.0|p1|m1' AS cache_key FROM contract_clauses)\n"


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "contract_clauses", heavy=True)
    summary = F.concat(F.lit("Probation: "), F.coalesce(F.col("probation_days").cast("string"), F.lit("-")))
    c = c.withColumns({"text_hash": clause_hash(F.col("text_en")), "summary": summary})
    return ca.with_cache_key(c, RULES, "p1", "m1")


@query("cache_key", oracle(("contract_clauses",), _KEY + "SELECT contract_id, clause, cache_key FROM kk"))
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf).select("contract_id", "clause", "cache_key")


@query("cache_hit_miss", oracle(("contract_clauses",), _KEY + ", s AS (SELECT cache_key, min(lib) lib, bool_or(contract_id%2=0) stored FROM kk GROUP BY 1) SELECT CASE WHEN stored AND lib%5<>0 THEN 'hit' ELSE 'miss' END AS outcome, CAST(count(*) AS BIGINT) AS keys FROM s GROUP BY 1"))
def cache_hit_miss(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _keyed(spark, sf)
    # Half the contracts fill the cache; entries that name an unknown rule are not used.
    rule = F.when(F.col("lib") % 5 == 0, "NO-SUCH-RULE").otherwise("EOS-BASE-01")
    reply = F.concat(F.lit('{"clause":"15.1","matches":[{"ruleId":"'), rule, F.lit('","verdict":"unclear","severity":"low","confidence":"low","articles":[],"explanation":"x"}]}'))
    cache = keyed.where("contract_id % 2 = 0").groupBy("cache_key").agg(F.min("lib").alias("lib")).select("cache_key", reply.alias("result"))
    looked = ca.valid_hits(keyed, cache, RULES)
    hits = looked.where("cached IS NOT NULL").select("cache_key").distinct().select(F.lit("hit").alias("outcome"))
    misses = ca.distinct_misses(looked).select(F.lit("miss").alias("outcome"))
    return hits.unionByName(misses).groupBy("outcome").agg(F.count(F.lit(1)).alias("keys"))


_REPLY_ERR = "CASE contract_id%5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'Rule \"NO-RULE\" is not one of the candidate rules.' WHEN 3 THEN 'Citation \"Art. 999\" (rule EOS-BASE-01) is not one of the articles provided.' ELSE 'The reply does not match the expected schema.' END"


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "contract_clauses", heavy=True).select("contract_id", "clause")
    kind = F.col("contract_id") % 5
    body = F.concat(
        F.lit('{"clause":"15.1","matches":[{"ruleId":"'), F.when(kind == 2, "NO-RULE").otherwise("EOS-BASE-01"), F.lit('","verdict":"likely_void","severity":"none","confidence":"high","articles":['),
        F.when(kind == 3, '"Art. 999"').when(kind == 0, '"Art. 84","Art. 84"').otherwise(""), F.lit('],"explanation":"e"}]}'),
    )
    reply = F.when(kind == 4, "no json here").when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return c.withColumn("reply", reply)


@query("reply_validate", oracle(("contract_clauses",), f"SELECT contract_id, clause, {_REPLY_ERR} AS error FROM contract_clauses"))
def reply_validate(spark: SparkSession, sf: str) -> DataFrame:
    return ca.check_replies(_replies(spark, sf), RULES).select("contract_id", "clause", "error")


@query("review_findings", oracle(("contract_clauses",), f"SELECT contract_id, clause, 'REVIEW-00' AS rule_id, 'unclear' AS verdict, 'low' AS severity, true AS needs_review, 'The analysis of this clause failed twice. Last problem: ' || {_REPLY_ERR} AS explanation FROM contract_clauses WHERE contract_id%5>=2"))
def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    rejected = ca.check_replies(_replies(spark, sf), RULES).where("error IS NOT NULL")
    return ca.review_findings(rejected).select("contract_id", "clause", "rule_id", "verdict", "severity", "needs_review", "explanation")


@query("clause_findings", oracle(("contract_clauses",), "SELECT contract_id, clause, 'EOS-BASE-01' AS rule_id, 'likely_void' AS verdict, 'high' AS severity, CASE contract_id%5 WHEN 0 THEN 'Art. 84' ELSE 'Art. 2,Art. 84,Art. 8' END AS articles, 'eos_gap' AS impact_kind FROM contract_clauses WHERE contract_id%5<2"))
def clause_findings(spark: SparkSession, sf: str) -> DataFrame:
    ok = ca.check_replies(_replies(spark, sf), RULES).where("error IS NULL")
    twice = ok.withColumn("matches", F.concat("matches", "matches"))
    return ca.clause_findings(twice, RULES).select("contract_id", "clause", "rule_id", "verdict", "severity", F.array_join("articles", ",").alias("articles"), "impact_kind")


def _analyse_by_length(batches):
    """A deterministic plug-in: one finding for a text; by the text's length some replies are wrong once, some always."""
    for batch in batches:
        size = batch["text_en"].fillna("").str.len()
        wrong = (size % 7 == 5) | ((size % 7 == 3) & batch["previous_error"].isna())
        right = '{"clause":"x","matches":[{"ruleId":"EOS-BASE-01","verdict":"likely_void","severity":"none","confidence":"high","articles":[],"explanation":"e"}]}'
        yield batch[["cache_key"]].assign(reply=[None if w else right for w in wrong], input_tokens=size, output_tokens=10)


def _cross_by_number(batches):
    """A deterministic plug-in: a conflict with the first clause; of contracts with 1, 4, 7, ... clauses the reply names none of them."""
    for batch in batches:
        replies, sizes = [], []
        for items in batch["items"]:
            clause = "99.9" if len(items) % 3 == 1 else items[0]["clause"]
            sizes.append(100 * len(items))
            replies.append(
                '{"conflicts":[{"ruleId":"TYPE-CONFLICT-01","clause":"' + clause
                + '","templateClause":"5.1","severity":"none","confidence":"high","articles":[],"explanation":"x"}]}'
            )
        yield batch[["cache_key"]].assign(reply=replies, input_tokens=sizes, output_tokens=5)


def _analysed(spark: SparkSession, sf: str) -> analyser.Analysis:
    clauses = _keyed(spark, sf).drop("cache_key")
    no_cache = spark.createDataFrame([], "cache_key string, result string")
    return analyser.analyse(clauses, no_cache, RULES, _analyse_by_length, _cross_by_number, "p1", "m1")


_ASKED = """, asked AS (SELECT *, length(coalesce(text_en, '')) size FROM contract_clauses WHERE trim(coalesce(text_en,''))<>'' OR trim(coalesce(text_ar,''))<>'')
, whole AS (SELECT contract_id, min(clause) clause, count(*) m, min(probation_days) p, list_sort(list({'c': clause, 'e': text_en, 'a': text_ar})) items FROM asked GROUP BY 1)
"""


@query("analyser_findings", oracle(("contract_clauses",), _ASKED + """SELECT contract_id, clause, CASE WHEN size%7=5 THEN 'REVIEW-00' ELSE 'EOS-BASE-01' END AS rule_id, CASE WHEN size%7=5 THEN 'unclear' ELSE 'likely_void' END AS verdict,
 CASE WHEN size%7=5 THEN 'low' ELSE 'high' END AS severity, 'clause' AS source, CASE WHEN size%7=5 THEN 'The analysis of this clause failed twice. Last problem: The reply does not match the expected schema.' ELSE 'e' END AS explanation FROM asked
UNION ALL SELECT contract_id, CASE WHEN m%3<>1 THEN clause END, CASE WHEN m%3=1 THEN 'REVIEW-00' ELSE 'TYPE-CONFLICT-01' END, CASE WHEN m%3=1 THEN 'unclear' ELSE 'conflict' END, CASE WHEN m%3=1 THEN 'low' ELSE 'high' END,
 'cross_check', CASE WHEN m%3=1 THEN 'The cross-check of Section 15 failed twice. Last problem: The cross-check reply is not valid.' ELSE 'Contradicts clause 5.1. x' END FROM whole"""))
def analyser_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf).findings.select("contract_id", "clause", "rule_id", "verdict", "severity", "source", "explanation")


@query("analyser_usage", oracle(("contract_clauses",), _KEY.rstrip() + _ASKED + """, one AS (SELECT min(a.contract_id) contract_id, any_value(size) size, CASE WHEN any_value(size)%7 IN (3,5) THEN 2 ELSE 1 END calls
 FROM asked a JOIN kk ON kk.contract_id=a.contract_id AND kk.clause=a.clause GROUP BY cache_key)
, two AS (SELECT min(contract_id) contract_id, any_value(m) m, CASE WHEN any_value(m)%3=1 THEN 2 ELSE 1 END calls FROM whole GROUP BY p, items)
SELECT contract_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM (SELECT contract_id, calls*size i, calls*10 o FROM one UNION ALL SELECT contract_id, calls*m*100, calls*5 FROM two) GROUP BY 1"""))
def analyser_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf).usage


@query("cross_reply_validate", oracle(("contract_clauses",), "SELECT contract_id, CASE WHEN contract_id%5<>0 THEN 'The cross-check reply is not valid.' END AS error FROM contract_clauses GROUP BY 1"))
def cross_reply_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "contract_clauses", heavy=True).groupBy("contract_id").agg(F.collect_set("clause").alias("clauses"))
    kind = F.col("contract_id") % 5
    body = F.concat(
        F.lit('{"conflicts":[{"ruleId":"'), F.when(kind == 1, "EOS-BASE-01").otherwise("TYPE-CONFLICT-01"), F.lit('","clause":"'),
        F.when(kind == 2, "99.9").otherwise(F.array_min("clauses")), F.lit('","templateClause":"5.1","severity":"high","confidence":"'),
        F.when(kind == 4, "sure").otherwise("high"), F.lit('","articles":['), F.when(kind == 3, '"Art. 999"').otherwise(""), F.lit('],"explanation":"x"}]}'),
    )
    return ca.check_conflict_replies(rows.withColumn("reply", body), RULES).select("contract_id", "error")


_ENDS = "it ends when a project or specific work is completed"
# One wording states two types; of a fixed-term contract both are conflicts.
_SAYS = f"""CASE WHEN stated='fixed_term' THEN 'it runs for a fixed term'
 WHEN stated LIKE '%,indefinite' AND rec='fixed_term' THEN 'it runs for an unlimited period and {_ENDS}' ELSE '{_ENDS}' END"""
_RECORDED = "CASE rec WHEN 'fixed_term' THEN 'a fixed-term contract' ELSE 'an indefinite (open-ended) contract' END"


@query("conflict_findings", oracle(("contract_clauses",), q_clauses.NUMS + f""", st AS (SELECT *, {q_clauses.STATED} stated FROM cc)
, cf AS (SELECT *, CASE WHEN rec='fixed_term' AND stated='specific_work' THEN '5.1' ELSE '1' END related FROM st WHERE stated<>rec)
SELECT contract_id, clause, related AS related_clause, 'conflict' AS verdict, 'high' AS severity,
 'Contradicts clause ' || related || '. The contract is recorded as ' || {_RECORDED} || ', but this clause says ' || {_SAYS} || '; the recorded type most likely prevails.' AS explanation FROM cf"""))
def conflict_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = q_clauses.type_conflicts(spark, sf)
    return ca.conflict_findings(found.unionByName(found), RULES).select("contract_id", "clause", "related_clause", "verdict", "severity", "explanation")


@query("usage_totals", "SELECT l_orderkey AS contract_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber) AS BIGINT) AS output_tokens FROM lineitem GROUP BY 1")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"))
    return ca.usage_totals(rows)


@query("redact_clauses", oracle(("contract_clauses",), "SELECT contract_id, clause, sha256(trim(regexp_replace(lower(text_en), '\\s+', ' ', 'g'))) AS text_hash FROM contract_clauses"))
def redact_clauses_query(spark: SparkSession, sf: str) -> DataFrame:
    return redact_clauses(load(spark, sf, "contract_clauses", heavy=True)).select("contract_id", "clause", "text_hash")
