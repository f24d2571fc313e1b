"""Law corpus and rule table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators.law import row_id
from pactum.operators.rule_table import RuleSet, read_rules

CORPUS_SCHEMA = (
    "lawVersion string, source string, article string, paragraph string, textAr string, "
    "textEnUnofficial string, sourceUrl string, effectiveFrom date, effectiveTo date"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a JSON corpus with their stable ids; the maintainers' notes are not read."""
    raw = spark.read.schema(CORPUS_SCHEMA).json(path, multiLine=True)
    rows = raw.select(
        F.col("lawVersion").alias("law_version"), "source", "article", "paragraph",
        F.col("textAr").alias("text_ar"), F.col("textEnUnofficial").alias("text_en"),
        F.col("sourceUrl").alias("source_url"), F.col("effectiveFrom").alias("effective_from"),
        F.col("effectiveTo").alias("effective_to"),
    )
    return rows.withColumn("id", row_id())


__all__ = ["RuleSet", "read_corpus", "read_rules"]
