"""Mixing sources to target weights by repetition: whole copies plus one hash-seeded coin.

Each source has a target number of words. The source's rate is target / size; a document is emitted
``floor(rate)`` times, and once more if a coin seeded by its id and text falls below the fraction of the rate.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows without an id and
rows that share one draw apart by their texts, only rows with the same id and text draw the same coin; a source without words has target and rate 0; an empty
table gives an empty result. Columns of the input that clash with the names used here are not read
(only id, text and source are), and :func:`mix` returns the input's columns unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import hash_unit, small, text_of, word_count, written

#: Weights dealt in turn to the sources in code-point order, null last.
WEIGHTS = (5, 2, 1)
#: All targets together, and one target at most, as multiples of all sizes and of the source's size.
TOTAL_SHARE = 1.5
MOST_REPEATS = 2


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size): one row for each source.

    A target above its cap stops there and the excess is shared again by weight. That ends at one
    common level: target = min(cap, level * weight). Sources are taken by cap / weight; the level is
    what is left for the first source that the level before it does not fill. The windows run over
    one row per source, never over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights) + 1
    weighted = totals.withColumn("rank", F.row_number().over(in_order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn)
    )
    cap = F.col("source_size") * most_repeats
    by_cap = Window.orderBy(cap / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(total_share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum(cap).over(before), F.lit(0)
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = (
        weighted.withColumn("cap", cap.cast("double"))
        .withColumn("level", left / weight_left)
        .withColumn("open", F.col("level") < F.col("cap") / F.col("weight"))
    )
    level = F.max(F.when(F.col("open"), F.col("level"))).over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    ))
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return filled.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def copies(docs: DataFrame, **options) -> DataFrame:
    """(doc, mix): each row of the input as a struct, and its size, source_size, target and copies."""
    sized = docs.select(F.struct("*").alias("doc"), word_count(text_of()).alias("size"))
    targets = written(source_targets(sized.select("doc.source", "size"), **options), "mix-targets")
    targets = targets.select(F.col("source").alias("of_source"), "source_size", "target", "rate")
    joined = sized.join(small(targets), F.col("doc.source").eqNullSafe(F.col("of_source")), "left")
    whole = F.floor("rate")
    coin = hash_unit(F.lit("mix"), F.col("doc.doc_id"), F.md5(text_of("doc.text"))) < F.col("rate") - whole
    return joined.select("doc", F.struct("size", "source_size", "target", (whole + coin.cast("long")).alias("copies")).alias("mix"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of the input as often as its source's rate and its coin say."""
    again = F.explode(F.array_repeat("doc", F.col("mix.copies").cast("int"))).alias("doc")
    return copies(docs, **options).select(again).select("doc.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: what the mix takes of it."""
    return copies(docs.select("doc_id", "text", "source"), **options).select(
        "doc.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"),
    )


#: DuckDB: documents with size, rate and copies; ``docs`` is the relation that is mixed.
COPIES_SQL = r"""
mix_sized AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS mix_size
  FROM {docs}),
mix_totals AS (
  SELECT source, CAST(sum(mix_size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM mix_sized GROUP BY source),
mix_weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM mix_totals),
mix_levels AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM mix_totals)::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
      / ((SELECT sum(weight) FROM mix_weighted) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM mix_weighted
  WINDOW before AS (ORDER BY 2 * source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_targets AS (
  SELECT source, source_size,
    least(cap, coalesce((SELECT max(level) FROM mix_levels WHERE level < cap / weight) * weight, cap)) AS target
  FROM mix_levels),
mix_rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM mix_targets),
mix_copies AS (
  SELECT d.*, r.source_size, r.target,
    CAST(floor(r.rate) AS BIGINT) + CAST(
      ('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0::DOUBLE
        < r.rate - floor(r.rate) AS BIGINT) AS copies
  FROM mix_sized d JOIN mix_rates r ON d.source IS NOT DISTINCT FROM r.source)
"""

SQL = "WITH " + COPIES_SQL.format(docs="documents") + """
SELECT doc_id, mix_size AS size, source_size, target, copies * mix_size AS taken FROM mix_copies
"""
