"""The analyser flow: both plug-in calls over many contracts, from clauses to findings, usage and cache entries.

Clauses (step 1): keyed, looked up, and what the cache lacks is asked once for each distinct request; answers are joined
back to every clause that asked, and become entries of the cache. Cross-check (step 2): one request for a contract, all
its clauses with the field summary; equal requests of several contracts are asked once as well. A reply that is not
valid is asked once more with what was wrong; after that, clauses or contracts get a review finding. Replies are written
once, so nothing that builds on them asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.operators import clause_analysis as ca
from pactum.operators.law import allowed_citations
from pactum.operators.rule_table import RuleSet
from pactum.session import cut_lineage
from pactum.sources.tables import upsert_latest

#: A plug-in: a ``mapInPandas`` function from requests (``cache_key``, the request's columns and ``previous_error``)
#: to ``cache_key, reply`` and, where it knows them, ``input_tokens, output_tokens``.
Plugin = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
REPLIES = "cache_key string, reply string, input_tokens long, output_tokens long"


@dataclass(frozen=True)
class Answers:
    """accepted and rejected: requests with what their last reply held; usage: ``cache_key, attempt`` and tokens."""

    accepted: DataFrame
    rejected: DataFrame
    usage: DataFrame


@dataclass(frozen=True)
class Analysis:
    """findings of both steps, usage of each contract, and the new entries of the cache (``cache_key, result, created_at``)."""

    findings: DataFrame
    usage: DataFrame
    entries: DataFrame


def _plain(reply: pd.DataFrame) -> pd.DataFrame:
    tokens = {c: reply[c].astype("int64") if c in reply else pd.Series(0, index=reply.index) for c in ("input_tokens", "output_tokens")}
    return pd.DataFrame({c: pd.Series(list(reply[c]), dtype=object, index=reply.index) for c in ("cache_key", "reply")} | tokens)


def _guarded(plugin: Plugin) -> Plugin:
    """A call that throws is made again row by row; a row that throws again has a null reply."""

    def alone(row: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [_plain(r) for r in plugin(iter([row]))]
        except Exception:  # noqa: BLE001  any failure of a plug-in is an invalid reply
            return [_plain(pd.DataFrame({"cache_key": row["cache_key"], "reply": [None]}))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies = [_plain(r) for r in plugin(iter([batch]))]
            except Exception:  # noqa: BLE001
                replies = [r for k in range(len(batch)) for r in alone(batch.iloc[k : k + 1].reset_index(drop=True))]
            yield from replies

    return run


def _asked(requests: DataFrame, plugin: Plugin, attempt: int) -> DataFrame:
    """Every request with its reply (the least, where a plug-in answers a key twice; null without an answer), written once."""
    replies = requests.mapInPandas(_guarded(plugin), REPLIES).groupBy("cache_key").agg(
        F.min("reply").alias("reply"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    tokens = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("input_tokens", "output_tokens")]
    keep = [c for c in requests.columns if c != "previous_error"]
    return cut_lineage(requests.join(replies, "cache_key", "left").select(*keep, "reply", *tokens, F.lit(attempt).alias("attempt")))


def ask(requests: DataFrame, plugin: Plugin, check: Callable[[DataFrame], DataFrame]) -> Answers:
    """Asks for every request, and once more, with the error, for those whose reply ``check`` gives an ``error``."""
    first = check(_asked(requests.withColumn("previous_error", F.lit(None).cast("string")), plugin, 1))
    failed = first.where("error IS NOT NULL")
    again = failed.select(*requests.columns, F.col("error").alias("previous_error"))
    second = check(_asked(again, plugin, 2))
    last = first.where("error IS NULL").unionByName(second)
    usage = ["cache_key", "attempt", "input_tokens", "output_tokens"]
    return Answers(last.where("error IS NULL"), last.where("error IS NOT NULL"), first.select(*usage).unionByName(second.select(*usage)))


def citations_of(rules: RuleSet, articles: DataFrame | None) -> list[str]:
    """What a reply may cite: the rules' own articles and those of the table (``citation``; the articles of one law)."""
    own = [a for r in rules.rules for a in r["articles"]]
    if articles is None:
        return list(dict.fromkeys(own))
    return [r.citation for r in allowed_citations(own, articles).orderBy("citation").collect()]


def _first_asker(keyed: DataFrame, usage: DataFrame) -> DataFrame:
    """Usage of each contract: a request that several contracts share is charged to the least of them."""
    askers = keyed.groupBy("cache_key").agg(F.min("contract_id").alias("contract_id"))
    return usage.join(askers, "cache_key").select("contract_id", "input_tokens", "output_tokens")


def analyse(
    clauses: DataFrame,
    cache: DataFrame,
    rules: RuleSet,
    plugin: Plugin,
    cross_plugin: Plugin | None,
    prompt_version: str,
    model: str,
    articles: DataFrame | None = None,
) -> Analysis:
    """Findings, usage and new cache entries of ``clauses`` (``contract_id, clause, text_en, text_ar, text_hash, summary``).

    ``cache``: ``cache_key, result``. ``articles``: a table of citations that replies may name beside the rules' own;
    it is small (a law's articles), and collected.
    """
    citations = citations_of(rules, articles)
    keyed = ca.with_cache_key(ca.with_text(clauses), rules, prompt_version, model)
    looked = ca.valid_hits(keyed, cache, rules)
    asked = ask(ca.distinct_misses(looked), plugin, lambda df: ca.check_replies(df, rules, citations))

    own = keyed.select("contract_id", "clause", "cache_key")
    hits = looked.where("cached IS NOT NULL").select("contract_id", "clause", ca.reply_matches(F.col("cached")).alias("matches"))
    answered = own.join(asked.accepted.select("cache_key", "matches"), "cache_key").drop("cache_key")
    findings = ca.clause_findings(hits.unionByName(answered), rules)
    review = own.join(asked.rejected.select("cache_key", "error"), "cache_key")
    findings = findings.unionByName(ca.review_findings(review))
    usage = _first_asker(own, asked.usage)
    entries = asked.accepted.select("cache_key", ca.extract_json(F.col("reply")).alias("result"), F.current_timestamp().alias("created_at"))

    if cross_plugin is not None and rules.of_kind("cross"):
        numbered = F.sort_array(F.collect_list(F.struct("clause", "text_en", "text_ar")))
        requests = ca.with_text(clauses).groupBy("contract_id").agg(F.min("summary").alias("summary"), numbered.alias("items"))
        requests = requests.withColumn("cache_key", F.sha2(F.to_json(F.struct("summary", "items")), 256)).withColumn(
            "clauses", F.transform("items", lambda c: c["clause"])
        )
        distinct = requests.groupBy("cache_key").agg(*[F.first(c).alias(c) for c in ("summary", "items", "clauses")])
        cross = ask(distinct, cross_plugin, lambda df: ca.check_conflict_replies(df, rules, citations))
        of_contract = requests.select("contract_id", "cache_key")
        findings = findings.unionByName(ca.conflict_findings(conflicts(of_contract.join(cross.accepted, "cache_key")), rules))
        failed = of_contract.join(cross.rejected.select("cache_key", "error"), "cache_key").withColumn("clause", F.lit(None).cast("string"))
        findings = findings.unionByName(ca.review_findings(failed, "cross_check"))
        usage = usage.unionByName(_first_asker(of_contract, cross.usage))
    return Analysis(findings, ca.usage_totals(usage), entries)


def conflicts(accepted: DataFrame) -> DataFrame:
    """Accepted cross-check replies as rows of conflicts."""
    rows = accepted.select("contract_id", F.posexplode("conflicts").alias("i", "c"))
    return rows.select(
        "contract_id", F.col("c.clause").alias("clause"), F.col("c.ruleId").alias("rule_id"), F.col("c.templateClause").alias("template_clause"),
        F.col("c.severity").alias("severity"), F.col("c.confidence").alias("confidence"), F.col("c.articles").alias("articles"),
        F.col("c.explanation").alias("explanation"),
    )


def remembered(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache (``cache_key, result, created_at``) after a run: of a key written again, the later entry."""
    return upsert_latest(cache, entries, ["cache_key"])
