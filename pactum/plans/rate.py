"""Rating contracts from fields and clauses, or from word layouts, to findings and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.functions.redaction import redact_clauses, redact_text, redaction_context
from pactum.operators import clause_analysis, clause_detectors, extract, field_rules, impact, layout, report, score
from pactum.operators.rule_table import RuleSet
from pactum.session import scratch
from pactum.sources.tables import stored


@dataclass
class Rating:
    """Result tables keyed by ``contract_id``; findings are written, the others derive from written tables."""

    findings: DataFrame
    deadlines: DataFrame
    scores: DataFrame
    status: DataFrame
    reasons: DataFrame
    clauses: DataFrame


def rate(fields: DataFrame, clauses: DataFrame, rules: RuleSet, today: str, folder: str | None = None) -> Rating:
    """Fields, clauses and findings are each computed once, written below ``folder`` (a new one in the
    shared checkpoint folder by default) and read from there by everything that builds on them.

    ``fields``: one row per contract with the typed fields and, where extraction ran,
    ``needs_review`` and ``issues``. ``clauses``: ``contract_id, clause, text_en, text_ar``,
    already redacted.
    """
    for name, type_name in (("needs_review", "boolean"), ("issues", f"array<{extract.ISSUE_TYPE}>")):
        if name not in fields.columns:
            default = F.lit(False) if name == "needs_review" else F.array()
            fields = fields.withColumn(name, default.cast(type_name))
    folder = folder or scratch(fields.sparkSession, "rating")
    fields, clauses = stored(fields, f"{folder}/fields"), stored(clauses, f"{folder}/clauses")
    known = fields.select("contract_id", "probation_days", F.col("contract_type").alias("_recorded"))
    texts = clause_analysis.with_text(clauses).join(known, "contract_id")
    analysed = clause_detectors.analyse_clauses(texts, rules)
    recorded = F.when(F.col("_recorded") != "unknown", F.col("_recorded"))
    conflicts = clause_detectors.type_conflicts(analysed, rules, recorded)
    findings = report.union_steps(
        field_rules.field_findings(fields, rules),
        clause_analysis.clause_findings(analysed, rules),
        clause_analysis.conflict_findings(conflicts, rules),
    )
    findings = stored(impact.apply_impact(findings, fields), f"{folder}/findings")
    status = score.rating_status(fields.select("contract_id", "needs_review"), findings)
    reasons = score.review_reasons(fields.select("contract_id", "issues").join(status, "contract_id"), findings)
    return Rating(
        findings,
        field_rules.deadlines(fields, rules, today),
        score.score_both_views(findings, fields),
        status,
        reasons,
        clauses,
    )


def rate_layouts(
    words: DataFrame, rules: RuleSet, today: str, ocr: DataFrame | None = None, folder: str | None = None
) -> tuple[Rating, DataFrame]:
    """Word boxes to ratings, and the rejected documents with the reason. Rows, extraction and what
    :func:`rate` writes are each computed once.

    ``ocr``: optional ``doc_id, text`` read from the Arabic regions of Section 15. Names are
    used for redaction only and are in no result.
    """
    folder = folder or scratch(words.sparkSession, "rating")
    rows = stored(layout.page_rows(words), f"{folder}/rows")
    detected = stored(layout.detect(rows), f"{folder}/detected")
    accepted = rows.join(detected.where("ok").select("doc_id"), "doc_id", "left_semi")
    extracted = stored(extract.extract_fields(layout.documents(accepted)), f"{folder}/extracted")
    arabic = F.lit(None).cast("string")
    if ocr is not None:
        extracted = extracted.join(ocr.select("doc_id", F.col("text").alias("_ocr")), "doc_id", "left")
        arabic = F.col("_ocr")
    attached = extract.attach_ocr(F.col("clauses"), F.coalesce(arabic, F.lit("")))
    pairs = F.arrays_zip(F.col("clauses").alias("en"), attached.alias("ar"))
    clauses = extracted.select(F.col("doc_id").alias("contract_id"), F.explode(pairs).alias("p")).select(
        "contract_id", F.col("p.en.number").alias("clause"),
        F.col("p.en.text_en").alias("text_en"), F.col("p.ar.text_ar").alias("text_ar"),
    )
    context = redaction_context(extract.party_names(extracted)).withColumnRenamed("doc_id", "contract_id")
    redacted = redact_clauses(clauses, context)
    fields = extracted.drop("lines", "footers", "sections", "labels", "clauses", "_ocr").withColumnRenamed("doc_id", "contract_id")
    fields = fields.join(context, "contract_id", "left").withColumn(
        "issues",
        F.transform("issues", lambda i: F.struct(i["field"].alias("field"), redact_text(i["message"], F.col("names")).alias("message"))),
    ).drop("names")
    return rate(fields, redacted, rules, today, folder), detected.where("NOT ok").select("doc_id", "reason")
