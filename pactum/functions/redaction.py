"""Replacement of identifying strings by placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.text import (
    SPACE,
    clause_hash,
    collapse,
    escape_regex,
    is_arabic,
    loose_arabic,
    normalise_arabic,
)

# Digit classes and the ordered patterns, most specific first.
D = r"[0-9٠-٩۰-۹]"
SEP = SPACE.replace("[", "[-", 1) + "{0,3}"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("iban", rf"(?<![A-Za-z0-9_])[Ss][Aa]{SEP}(?:{D}{SEP}){{11,21}}{D}", "[IBAN]"),
    ("phone_intl", rf"(?<!{D})(?:(?:\+|00){SEP})?966(?:{SEP}{D}){{8,9}}(?!{D})", "[PHONE]"),
    ("phone_local", rf"(?<!{D})[0٠۰]{SEP}[5٥۵](?:{SEP}{D}){{8}}(?!{D})", "[PHONE]"),
    ("id", rf"(?<!{D})[127١٢٧۱۲۷]{D}{{9}}(?!{D})", "[ID]"),
)
MIN_NAME_LETTERS = 3
NAME_TYPE = "array<struct<n:int,pattern:string,placeholder:string>>"


def redact_patterns(text: Column) -> Column:
    for _, pattern, placeholder in PATTERNS:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def pattern_counts(text: Column) -> list[Column]:
    """Hits per pattern, each counted after the earlier ones were replaced."""
    counts = []
    for name, pattern, placeholder in PATTERNS:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(f"n_{name}"))
        text = F.regexp_replace(text, pattern, placeholder)
    return counts


def name_pattern(clean: Column) -> Column:
    """Pattern of one normalised name, null when it has too few letters to be safe."""
    letters = F.length(F.regexp_replace(clean, r"[^\p{L}]", ""))
    arabic = F.concat(
        F.lit("(?:"), loose_arabic(clean), F.lit(")|(?:"), loose_arabic(F.reverse(clean)), F.lit(")")
    )
    words = F.array_join(F.transform(F.split(clean, " "), escape_regex), SPACE + "+")
    latin = F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])"), words, F.lit(r"(?![\p{L}\p{N}])")
    )
    return F.when(letters >= MIN_NAME_LETTERS, F.when(is_arabic(clean), arabic).otherwise(latin))


def redaction_context(names: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, names``: one list of patterns per document, longest name first.

    ``names``: ``key, order, text, placeholder``; the first row of equal names gives the
    placeholder. The aggregate holds only the names of one document.
    """
    clean = names.select(
        key, "order", collapse(F.col("text")).alias("name"), "placeholder"
    ).where("name <> ''")
    first = clean.groupBy(key, "name").agg(F.min_by("placeholder", "order").alias("placeholder"))
    rows = first.select(
        key,
        F.length("name").alias("n"),
        name_pattern(normalise_arabic(F.col("name"))).alias("pattern"),
        F.coalesce("placeholder", F.lit("[NAME]")).alias("placeholder"),
    ).where("pattern IS NOT NULL")
    return rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("n", "pattern", "placeholder")), asc=False)
        .cast(NAME_TYPE)
        .alias("names")
    )


def redact_text(text: Column, names: Column | None = None) -> Column:
    """Fixed patterns, then the document's names."""
    text = redact_patterns(text)
    if names is None:
        return text
    replaced = F.aggregate(
        names, text, lambda t, n: F.regexp_replace(t, n["pattern"], n["placeholder"])
    )
    return F.when(names.isNull(), text).otherwise(replaced)


def redact_clauses(clauses: DataFrame, context: DataFrame | None = None, key: str = "contract_id") -> DataFrame:
    """Both languages redacted, the hash taken again from the redacted English."""
    names = None
    if context is not None:
        clauses = clauses.join(context, key, "left")
        names = F.col("names")
    out = clauses.withColumns(
        {
            "text_en": redact_text(F.col("text_en"), names),
            "text_ar": redact_text(F.col("text_ar"), names),
        }
    ).withColumn("text_hash", clause_hash(F.col("text_en")))
    return out.drop("names") if context is not None else out
