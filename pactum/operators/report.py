"""Report views: buckets, orders, titles, passages, numbering, page marks, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.operators.impact import sar_at_stake
from pactum.operators.verdicts import (
    LEGAL_RISK_RANK,
    REVIEW_RULE_ID,
    SEVERITY_RANK,
    is_problem,
    rank,
)

# Fixed values.
REVIEW_TITLE = "Needs a manual review"
SEVERITY_TONE = {"high": "critical", "medium": "serious", "low": "warning", "none": "neutral"}
DEFAULT_PAGE_SIZE = (595.92, 842.04)
PROGRESS_PERCENT = {"queued": 25, "extracting": 50, "analysing": 75}


def with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``title`` and ``bucket`` (problem, good, info or null) from the rule table."""
    r = rules.select(
        F.col("id").alias("rule_id"), F.col("title").alias("_title"), F.col("good_msg").isNotNull().alias("_good")
    )
    info = F.col("source") == "info"
    bucket = (
        F.when(info, "info")
        .when(is_problem(F.col("verdict")), "problem")
        .when(F.col("_good"), "good")
    )
    fallback = F.when(F.col("rule_id") == REVIEW_RULE_ID, REVIEW_TITLE).otherwise(F.col("rule_id"))
    return (
        findings.join(r, "rule_id", "left")
        .withColumns({"title": F.coalesce("_title", fallback), "bucket": bucket})
        .drop("_title", "_good")
    )


def problems(findings: DataFrame) -> DataFrame:
    return findings.where((F.col("source") != "info") & is_problem(F.col("verdict")))


def order_findings(findings: DataFrame, view: str) -> DataFrame:
    """Problems with their rank in the view; ties keep pipeline order (``position``)."""
    severity = rank(F.col("severity"), SEVERITY_RANK)
    if view == "employee":
        order = [sar_at_stake(F.col("impact")).desc(), severity, F.col("position")]
    else:
        order = [severity, rank(F.col("verdict"), LEGAL_RISK_RANK), F.col("position")]
    w = Window.partitionBy("contract_id").orderBy(*order)
    return problems(findings).withColumn("rank", F.row_number().over(w))


def union_steps(field: DataFrame, clause: DataFrame, cross: DataFrame) -> DataFrame:
    """The three steps' findings with a ``position`` that keeps pipeline order."""
    stacked = field.unionByName(clause, allowMissingColumns=True).unionByName(
        cross, allowMissingColumns=True
    )
    return with_positions(stacked, "step", "step_order")


def with_positions(findings: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("contract_id").orderBy(*order)
    return findings.withColumn("position", (F.row_number().over(w) - 1).cast("bigint")).drop(*order)


def filter_by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings if severity == "all" else findings.where(F.col("severity") == severity)


def likely_void(findings: DataFrame) -> DataFrame:
    return findings.where("verdict = 'likely_void'")


def ancestors(reference: Column) -> Column:
    """``9.1.1`` gives ``[9.1.1, 9.1, 9]``, nearest first."""
    parts = F.split(reference, r"\.")
    return F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
        lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."),
    )


def passages(findings: DataFrame, locations: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """One row per finding, reference and page: where the finding is printed.

    All rows meet by contract, so tables that are dealt out by it are not shuffled again, and no row is spread before it
    meets the boxes of its contract. Of a reference's ancestors that have a box the nearest stays, so a finding carries the
    boxes and texts of its own clauses only, and none are collected.
    """
    refs = F.array_distinct(F.array_compact(F.array("clause", "related_clause")))
    wanted = findings.select("contract_id", "position", F.posexplode(refs).alias("ref_no", "reference")).withColumn(
        "_ancestors", ancestors(F.col("reference"))
    )
    places = locations.select("contract_id", "clause", "page", "page_width", "page_height", "x_min", "y_min", "x_max", "y_max")
    if clauses is not None:
        text = F.struct("text_en", "text_ar").alias("_text")
        both = places.withColumn("_place", F.lit(True)).unionByName(clauses.select("contract_id", "clause", text), allowMissingColumns=True)
        texts = F.max("_text").over(Window.partitionBy("contract_id", "clause"))
        places = both.withColumn("_text", texts).where("_place").select(*places.columns, "_text.text_en", "_text.text_ar")
    else:
        places = places.withColumns({c: F.lit(None).cast("string") for c in ("text_en", "text_ar")})
    places = places.withColumnRenamed("contract_id", "_contract")
    own = (F.col("contract_id") == F.col("_contract")) & F.array_contains("_ancestors", F.col("clause"))
    found = wanted.join(places, own).withColumn("distance", F.array_position("_ancestors", F.col("clause")))
    in_order = Window.partitionBy("contract_id", "position", "ref_no").orderBy(
        "distance", "page", "y_min", "page_width", "page_height", "x_min", "x_max", "y_max"
    )
    # The nearest ancestor comes first, so its boxes are numbered from 0.
    numbered = found.withColumns({"box_no": F.row_number().over(in_order) - 1, "_nearest": F.first("distance").over(in_order)})
    return numbered.where(F.col("distance") == F.col("_nearest")).select(
        "contract_id", "position", "ref_no", "box_no", "clause", "page", "page_width", "page_height", "x_min", "y_min",
        "x_max", "y_max", "text_en", "text_ar", (F.col("clause") != F.col("reference")).alias("approximate"),
    )


def first_passage(passage_rows: DataFrame) -> DataFrame:
    first = F.min_by(
        F.struct("clause", "page", "y_min", "approximate"), F.struct("ref_no", "box_no")
    )
    return passage_rows.groupBy("contract_id", "position").agg(first.alias("passage"))


def contract_numbering(items: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """Numbers exactly placed findings per tab in reading order; others stay unnumbered.

    ``items``: findings with ``tab`` (``issues`` or ``good``). Placed and unplaced rows form
    two window groups, so no join back is needed. Items and first passages are stacked and dealt out by contract once.
    """
    stacked = items.withColumn("_item", F.lit(True)).unionByName(first_passage(passage_rows), allowMissingColumns=True)
    stacked = stacked.repartition("contract_id")
    first = F.first("passage", ignorenulls=True).over(Window.partitionBy("contract_id", "position"))
    joined = stacked.withColumn("passage", F.when(F.col("position").isNotNull(), first)).where("_item").drop("_item")
    placed = F.col("passage").isNotNull() & ~F.col("passage.approximate")
    joined = joined.withColumn("_placed", F.coalesce(placed, F.lit(False)))
    w = Window.partitionBy("contract_id", "tab", "_placed").orderBy(
        "passage.page", "passage.y_min", "passage.clause", "position"
    )
    numbered = joined.withColumn("number", F.when(F.col("_placed"), F.row_number().over(w)))
    order = Window.partitionBy("contract_id", "tab").orderBy(
        F.when(F.col("tab") == "issues", rank(F.col("severity"), SEVERITY_RANK)).otherwise(0),
        F.col("number").asc_nulls_last(),
        "position",
    )
    return numbered.withColumn("list_no", F.row_number().over(order)).drop("_placed")


def page_marks(items: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """Every passage of every shown item with its tone."""
    tone = F.lit(None).cast("string")
    for severity, name in SEVERITY_TONE.items():
        tone = F.when(F.col("severity") == severity, name).otherwise(tone)
    return items.join(passage_rows.drop("clause_text"), ["contract_id", "position"]).withColumn(
        "tone", F.when(F.col("tab") == "good", "good").otherwise(tone)
    )


def page_sizes(documents: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """Size of every page of a document: known from a passage, else A4."""
    known = passage_rows.groupBy("contract_id", "page").agg(
        F.max("page_width").alias("w"), F.max("page_height").alias("h")
    )
    pages = documents.select("contract_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page"))
    return pages.join(known, ["contract_id", "page"], "left").select(
        "contract_id",
        "page",
        F.coalesce("w", F.lit(DEFAULT_PAGE_SIZE[0])).alias("width"),
        F.coalesce("h", F.lit(DEFAULT_PAGE_SIZE[1])).alias("height"),
    )


def finding_anchor(rule_id: Column, clause: Column) -> Column:
    suffix = F.concat(F.lit("-"), F.regexp_replace(clause, "[^A-Za-z0-9]", "-"))
    return F.concat(F.lit("finding-"), rule_id, F.coalesce(suffix, F.lit("")))


def progress_percent(status: Column) -> Column:
    out = F.lit(100)
    for name, percent in PROGRESS_PERCENT.items():
        out = F.when(status == name, percent).otherwise(out)
    return out


def fields_to_rows(fields: DataFrame, names: list[str], provenance: dict[str, Column] | None = None) -> DataFrame:
    """Wide to tall: one row per field with its value as JSON, page and confidence."""
    page = lambda n: F.try_element_at("pages", F.lit(n)) if "pages" in fields.columns else F.lit(None).cast("int")
    conf = lambda n: (
        F.try_element_at("confidences", F.lit(n)) if "confidences" in fields.columns else F.lit(None).cast("string")
    )
    entries = [
        F.struct(
            F.lit(n).alias("field"),
            _json(fields, n).alias("value"),
            page(n).cast("int").alias("page"),
            F.coalesce(conf(n), F.lit("low")).alias("confidence"),
        )
        for n in names
    ]
    return fields.select("contract_id", F.inline(F.array(*entries)))


def _json(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind in ("struct", "array", "map"):
        return F.to_json(F.col(name))
    if kind in ("string", "date"):
        # A JSON string: encode inside a one-element array and drop the brackets.
        wrapped = F.to_json(F.array(F.col(name).cast("string")))
        return F.when(F.col(name).isNotNull(), F.regexp_replace(wrapped, r"^\[|\]$", ""))
    return F.col(name).cast("string")


def rows_to_fields(rows: DataFrame, types: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Tall to wide over defaults: one pass of conditional aggregates, no pivot discovery."""
    defaults = defaults or {}
    picked = [
        F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in types
    ]
    wide = rows.groupBy("contract_id").agg(*picked)
    out = []
    for name, type_name in types.items():
        raw = F.col(name)
        if type_name.startswith(("struct", "array", "map")):
            value = F.from_json(raw, type_name)
        elif type_name in ("string", "date"):
            value = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v").cast(type_name)
        else:
            value = raw.cast(type_name)
        if name in defaults:
            value = F.coalesce(value, defaults[name])
        out.append(value.alias(name))
    return wide.select("contract_id", *out)


def assemble(
    ratings: DataFrame,
    findings: DataFrame,
    field_rows: DataFrame,
    clauses: DataFrame,
    locations: DataFrame,
    documents: DataFrame,
) -> DataFrame:
    """A report per rating with its relations nested.

    Each relation is reduced to one row per rating before it meets the others, so the join is
    one-to-one and a busy rating is combined on the map side of its own aggregation. Documents come first, as they meet
    by another key: no nested rows are shuffled.
    """

    def nest(df: DataFrame, name: str, *order: str) -> DataFrame:
        cols = [c for c in (*order, *df.columns) if c != "contract_id"]
        cols = list(dict.fromkeys(cols))
        return df.groupBy("contract_id").agg(
            F.sort_array(F.collect_list(F.struct(*cols))).alias(name)
        )

    document = documents.select(
        "document_id",
        F.col("user_id"),
        F.struct(
            F.col("pages"),
            F.col("deleted_at").isNull().alias("available"),
            F.col("deleted_at"),
        ).alias("document"),
    )
    return (
        ratings.join(document, ["document_id", "user_id"], "left")
        .join(nest(findings, "findings", "position"), "contract_id", "left")
        .join(nest(field_rows, "fields", "field"), "contract_id", "left")
        .join(nest(clauses, "clauses", "clause"), "contract_id", "left")
        .join(nest(locations, "locations", "page", "y_min", "clause"), "contract_id", "left")
    )


def rating_documents(ratings: DataFrame, documents: DataFrame) -> DataFrame:
    """Each rating's document within its owner, and whether the file can be shown."""
    d = documents.select("document_id", "user_id", "deleted_at", F.lit(True).alias("_found"))
    found = F.coalesce("_found", F.lit(False))
    return ratings.join(d, ["document_id", "user_id"], "left").select(
        *[c for c in ratings.columns],
        (found & F.col("deleted_at").isNull()).alias("available"),
        "deleted_at",
    )
