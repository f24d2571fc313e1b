"""Clause analysis as a relation: cache keys, hits and misses, plug-in analysers, findings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pactum.operators.clause_detectors import MATCH_TYPE, PARAMS_TYPE, match_rows
from pactum.operators.messages import finding_texts
from pactum.operators.rule_table import RuleSet
from pactum.operators.verdicts import REVIEW_RULE_ID, is_problem
from pactum.session import cut_lineage

# Fixed values.
MAX_ERROR_LENGTH = 600
REVIEW_TEXTS = {
    "clause": (
        "This clause could not be analysed automatically; have someone read it.",
        "Automatic analysis of this clause failed; review it manually.",
    ),
    "cross_check": (
        "The additional terms could not be checked automatically; have someone read them.",
        "Automatic cross-check of Section 15 failed; review it manually.",
    ),
}
VERDICTS = (
    "likely_void", "worse_than_default", "conflict", "compliant", "better_than_law", "unclear",
)
SEVERITIES = ("high", "medium", "low", "none")
CONFIDENCES = ("high", "medium", "low")
REPLY_TYPE = (
    "struct<clause:string,matches:array<struct<ruleId:string,verdict:string,severity:string,"
    "confidence:string,articles:array<string>,explanation:string,impactParams:struct<"
    "eosBase:string,compensationMonths:double,compensationBase:string,nonCompeteMonths:double>>>>"
)
CONFLICT_REPLY_TYPE = (
    "struct<conflicts:array<struct<ruleId:string,clause:string,templateClause:string,"
    "severity:string,confidence:string,articles:array<string>,explanation:string>>>"
)


def with_text(clauses: DataFrame) -> DataFrame:
    """Clauses that have English or Arabic text."""
    return clauses.where(
        (F.trim("text_en") != "") | (F.coalesce(F.trim("text_ar"), F.lit("")) != "")
    )


def _json_string(value: Column) -> Column:
    inner = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(
        F.substring(inner, F.lit(2), F.length(inner) - 2)
    )


def input_hash(text_hash: Column, text_ar: Column, summary: Column) -> Column:
    """sha256 of the JSON list of everything in a request that can change its answer."""
    body = F.concat_ws(",", *[_json_string(c) for c in (text_hash, text_ar, summary)])
    return F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256)


def with_cache_key(
    clauses: DataFrame, rules: RuleSet, prompt_version: str, model: str
) -> DataFrame:
    """Adds the five key columns and their joined form. Needs ``text_hash, text_ar, summary``."""
    content = input_hash(F.col("text_hash"), F.col("text_ar"), F.col("summary"))
    versions = [rules.law_version, rules.ruleset_version, prompt_version, model]
    return clauses.withColumn(
        "cache_key", F.concat_ws("|", content, *[F.lit(v) for v in versions])
    )


def _shaped(m: Column) -> Column:
    return F.coalesce(
        m["ruleId"].isNotNull()
        & m["verdict"].isin(*VERDICTS)
        & m["severity"].isin(*SEVERITIES)
        & m["confidence"].isin(*CONFIDENCES)
        & m["articles"].isNotNull()
        & (F.length(m["explanation"]) > 0),
        F.lit(False),
    )


def valid_hits(clauses: DataFrame, cache: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds ``cached``: the stored matches, or null when absent or no longer valid.

    ``cache``: ``cache_key, result`` (JSON), one row per key. A hit counts only when every match in it
    has the reply's shape and its rule is still a candidate.
    """
    ids = F.array(*[F.lit(r["id"]) for r in rules.candidates().rules])
    parsed = F.from_json("result", REPLY_TYPE)
    usable = F.when(
        parsed["matches"].isNotNull()
        & F.forall(parsed["matches"], lambda m: _shaped(m) & F.array_contains(ids, m["ruleId"])),
        parsed["matches"],
    )
    stored = cache.select("cache_key", usable.alias("cached")).where("cached IS NOT NULL")
    return clauses.join(stored, "cache_key", "left")


def distinct_misses(keyed: DataFrame) -> DataFrame:
    """One row per key still to be analysed: equal work is done once, however often it occurs.

    Equal keys are combined before the shuffle, so a text a third of all contracts share costs
    one row per partition.
    """
    columns = [c for c in ("text_en", "text_ar", "summary", "probation_days") if c in keyed.columns]
    missing = keyed.where("cached IS NULL")
    return missing.groupBy("cache_key").agg(*[F.first(c).alias(c) for c in columns])


Analyser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _guarded(analyser: Analyser) -> Analyser:
    """A plug-in that throws is asked row by row; a row that throws again has a null reply."""

    def plain(reply: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(list(reply[c]), dtype=object) for c in ("cache_key", "reply")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield from [plain(r) for r in analyser(iter([batch]))]
            except Exception:  # noqa: BLE001  any failure of a plug-in is an invalid reply
                for k in range(len(batch)):
                    row = batch.iloc[k : k + 1].reset_index(drop=True)
                    try:
                        yield from [plain(r) for r in analyser(iter([row]))]
                    except Exception:  # noqa: BLE001
                        yield plain(pd.DataFrame({"cache_key": row["cache_key"], "reply": [None]}))

    return run


def _asked(misses: DataFrame, analyser: Analyser) -> DataFrame:
    """``cache_key, reply`` of every key asked, written once; a key without an answer has a null reply."""
    replies = misses.mapInPandas(_guarded(analyser), "cache_key string, reply string")
    # The least reply counts where a plug-in answers a key twice.
    one = replies.groupBy("cache_key").agg(F.min("reply").alias("reply"))
    return cut_lineage(misses.select("cache_key").join(one, "cache_key", "left"))


def run_analyser(
    misses: DataFrame, analyser: Analyser, rules: RuleSet, citations: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Runs a plug-in over the distinct misses, checks its replies, retries rejects once.

    ``analyser`` is a ``mapInPandas`` function: it gets the miss columns and ``previous_error``
    and gives ``cache_key, reply`` (JSON text). Results are ``(accepted, rejected)``, and every key is in
    one of them: an unanswered key and a call that throws are invalid replies. Replies are written to
    the shared checkpoint folder so that none is asked for twice.
    """
    first = _asked(misses.withColumn("previous_error", F.lit(None).cast("string")), analyser)
    checked = check_replies(first, rules, citations)
    failed = checked.where("error IS NOT NULL").select("cache_key", F.col("error").alias("previous_error"))
    second = _asked(misses.join(failed, "cache_key"), analyser)
    retried = check_replies(second, rules, citations)
    everything = checked.where("error IS NULL").unionByName(retried)
    return everything.where("error IS NULL").drop("error"), everything.where("error IS NOT NULL")


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)
_FENCE = re.compile(r"```[a-zA-Z]*\s*\n?([\s\S]*?)```")


def json_object(reply: str | None) -> str | None:
    """The JSON object in a reply: the whole text, else a fenced block, else the first that any brace opens."""

    def whole(text: str) -> bool:
        try:
            return text.startswith("{") and isinstance(json.loads(text, parse_constant=_no_constant), dict)
        except ValueError:
            return False

    if reply is None:
        return None
    text = reply.strip()
    for candidate in (text, *(f.strip() for f in _FENCE.findall(text))):
        if whole(candidate):
            return candidate
    at = text.find("{")
    while at >= 0:
        try:
            return text[at : _DECODER.raw_decode(text, at)[1]]
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def extract_json(replies: pd.Series) -> pd.Series:
    """:func:`json_object` of each reply; replies come from a Python plug-in, batch by batch."""
    return replies.map(json_object)


def check_replies(
    replies: DataFrame, rules: RuleSet, citations: list[str] | None = None
) -> DataFrame:
    """Adds ``matches`` and ``error`` (null when the reply may be used)."""
    candidates = rules.candidates()
    ids = F.array(*[F.lit(r["id"]) for r in candidates.rules])
    known = dict.fromkeys([a for r in candidates.rules for a in r["articles"]] + (citations or []))
    allowed = F.array(*[F.lit(a) for a in known]).cast("array<string>")
    parsed = F.from_json(extract_json(F.col("reply")), REPLY_TYPE)
    df = replies.withColumn("parsed", parsed)
    found = F.col("parsed.matches")

    def problems_of(m: Column) -> Column:
        rule = F.when(
            ~F.array_contains(ids, m["ruleId"]),
            F.concat(F.lit('Rule "'), m["ruleId"], F.lit('" is not one of the candidate rules.')),
        )
        cited = F.transform(
            F.array_except(m["articles"], allowed),
            lambda a: F.concat(
                F.lit('Citation "'), a, F.lit('" (rule '), m["ruleId"],
                F.lit(") is not one of the articles provided."),
            ),
        )
        return F.concat(F.array_compact(F.array(rule)), cited)

    valid = F.col("parsed.clause").isNotNull() & found.isNotNull() & F.forall(found, _shaped)
    text = F.array_join(F.flatten(F.transform(found, problems_of)), " ")
    error = F.when(
        ~F.coalesce(valid, F.lit(False)), "The reply does not match the expected schema."
    ).otherwise(F.nullif(text, F.lit("")))
    return df.withColumns({"error": shorten(error), "matches": reply_matches(found)}).drop("parsed")


def reply_matches(found: Column) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["ruleId"].alias("rule_id"),
            m["verdict"].alias("verdict"),
            m["severity"].alias("severity"),
            m["confidence"].alias("confidence"),
            m["articles"].alias("articles"),
            m["explanation"].alias("explanation"),
            F.struct(
                m["impactParams"]["eosBase"].alias("eos_base"),
                m["impactParams"]["compensationMonths"].alias("compensation_months"),
                m["impactParams"]["compensationBase"].alias("compensation_base"),
                m["impactParams"]["nonCompeteMonths"].alias("non_compete_months"),
            ).alias("params"),
        ),
    ).cast(f"array<{MATCH_TYPE}>")


def shorten(text: Column) -> Column:
    return F.when(
        F.length(text) > MAX_ERROR_LENGTH,
        F.concat(F.substring(text, 1, MAX_ERROR_LENGTH - 1), F.lit("…")),
    ).otherwise(text)


def check_conflict_replies(replies: DataFrame, rules: RuleSet, citations: list[str] | None = None) -> DataFrame:
    """As ``check_replies`` for cross-check replies; ``clauses`` lists the numbers sent."""
    cross = rules.of_kind("cross")
    ids = F.array(*[F.lit(r["id"]) for r in cross])
    known = dict.fromkeys([a for r in cross for a in r["articles"]] + (citations or []))
    allowed = F.array(*[F.lit(a) for a in known]).cast("array<string>")
    parsed = F.from_json(extract_json(F.col("reply")), CONFLICT_REPLY_TYPE)
    df = replies.withColumn("conflicts", parsed["conflicts"])

    def bad(c: Column) -> Column:
        shaped = (
            c["templateClause"].isNotNull() & c["severity"].isin(*SEVERITIES) & c["confidence"].isin(*CONFIDENCES)
            & (F.length(c["explanation"]) > 0)
        )
        return (
            ~shaped
            | ~F.array_contains(ids, c["ruleId"])
            | (F.size(F.array_except(c["articles"], allowed)) > 0)
            | ~F.array_contains("clauses", c["clause"])
        )

    ok = F.col("conflicts").isNotNull() & ~F.exists("conflicts", lambda c: F.coalesce(bad(c), F.lit(True)))
    return df.withColumn(
        "error", F.when(~F.coalesce(ok, F.lit(False)), "The cross-check reply is not valid.")
    )


# --- findings ------------------------------------------------------------------------------


def severity_for(verdict: Column, stated: Column) -> Column:
    """No severity on a passing verdict; a problem without one takes its rule's."""
    return (
        F.when(~is_problem(verdict), "none")
        .when(stated == "none", F.col("rule.severity_if_fail"))
        .otherwise(stated)
    )


def _clause_order(clause: Column) -> Column:
    return F.transform(F.split(clause, r"\."), lambda n: n.try_cast("int"))


def _finding_columns(verdict: Column, explanation: Column, related: Column, source: str, step: int, order: Column, params: Column) -> list[Column]:
    no_values = F.create_map().cast("map<string,string>")
    cited = F.when(F.size("articles") > 0, F.array_distinct("articles")).otherwise(
        F.col("rule.articles")
    )
    return [
        F.col("contract_id"),
        F.lit(step).alias("step"),
        order.alias("step_order"),
        F.col("rule_id"),
        F.col("clause"),
        related.alias("related_clause"),
        verdict.alias("verdict"),
        severity_for(verdict, F.col("severity")).alias("severity"),
        F.col("confidence"),
        F.col("rule.categories").alias("categories"),
        cited.alias("articles"),
        explanation.alias("explanation"),
        *finding_texts(verdict, no_values),
        F.lit(source).alias("source"),
        F.lit(False).alias("needs_review"),
        F.col("rule.impact").alias("impact_kind"),
        params.alias("impact_params"),
    ]


def clause_findings(analysed: DataFrame, rules: RuleSet) -> DataFrame:
    """Matches to findings: the first per clause and rule. Map-only; the rules are broadcast."""
    rule = rules.candidates().packed(analysed.sparkSession)
    # Detectors give at most one match per rule; other analysers may repeat one.
    ids = F.transform("matches", lambda m: m["rule_id"])
    rows = match_rows(analysed.withColumn("_ids", ids), "contract_id", "clause", "_ids")
    rows = rows.where(F.array_position("_ids", F.col("rule_id")) == F.col("i") + 1).drop("_ids")
    joined = rows.join(rule, F.col("rule_id") == F.col("rule.id"))
    # Clause numbers have up to four parts below 100; the match index breaks ties.
    order = _order_key(F.col("clause"), F.col("i"))
    verdict = F.col("verdict")
    columns = _finding_columns(
        verdict, F.col("explanation"), F.lit(None).cast("string"), "clause", 1, order, F.col("params")
    )
    return joined.select(*columns)


def _order_key(clause: Column, index: Column) -> Column:
    padded = F.slice(
        F.concat(_clause_order(clause), F.array_repeat(F.lit(0), 4)), F.lit(1), F.lit(4)
    )
    number = F.aggregate(
        padded, F.lit(0).cast("bigint"), lambda acc, n: acc * 1000 + F.coalesce(n, F.lit(0))
    )
    return number * 100 + F.coalesce(index, F.lit(0))


def conflict_findings(conflicts: DataFrame, rules: RuleSet) -> DataFrame:
    """Conflicts to findings: one per rule and clause, with the clause it contradicts."""
    rule = rules.packed(conflicts.sparkSession)
    unique = conflicts.dropDuplicates(["contract_id", "rule_id", "clause"])
    joined = unique.select(
        "contract_id", "clause", "rule_id", "template_clause", "severity", "confidence",
        "articles", "explanation",
    ).join(rule, F.col("rule_id") == F.col("rule.id"))
    text = F.concat(
        F.lit("Contradicts clause "), F.col("template_clause"), F.lit(". "), F.col("explanation")
    )
    columns = _finding_columns(
        F.lit("conflict"), text, F.col("template_clause"), "cross_check", 2,
        _order_key(F.col("clause"), F.lit(0)), F.lit(None).cast(PARAMS_TYPE),
    )
    return joined.select(*columns)


def review_findings(rejected: DataFrame, source: str = "clause") -> DataFrame:
    """The finding raised where no valid reply came: low severity, flagged for a person."""
    employee, hr = REVIEW_TEXTS[source]
    what = "The analysis of this clause" if source == "clause" else "The cross-check of Section 15"
    null = F.lit(None).cast("string")
    return rejected.select(
        "contract_id",
        F.lit(1 if source == "clause" else 2).alias("step"),
        _order_key(F.coalesce("clause", F.lit("0")), F.lit(0)).alias("step_order"),
        F.lit(REVIEW_RULE_ID).alias("rule_id"),
        "clause",
        null.alias("related_clause"),
        F.lit("unclear").alias("verdict"),
        F.lit("low").alias("severity"),
        F.lit("low").alias("confidence"),
        F.array(F.lit("clarity")).alias("categories"),
        F.array().cast("array<string>").alias("articles"),
        F.concat(F.lit(f"{what} failed twice. Last problem: "), F.col("error")).alias("explanation"),
        F.lit(employee).alias("employee_msg"),
        F.lit(hr).alias("hr_msg"),
        null.alias("ask_for"),
        null.alias("suggested_wording"),
        F.lit(source).alias("source"),
        F.lit(True).alias("needs_review"),
        null.alias("impact_kind"),
        F.lit(None).cast(PARAMS_TYPE).alias("impact_params"),
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    """Tokens per contract. ``usage``: ``contract_id, input_tokens, output_tokens``."""
    return usage.groupBy("contract_id").agg(
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
    )
