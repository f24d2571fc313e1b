"""The corpus pipeline: documents through five stages, each written and read again.

toxicity     documents scored as toxic go
line_dedup   blocks of lines that an earlier document holds go; documents left without a word go
near_dedup   one document of each group of near-duplicates stays, the one of the smallest id
mixing       documents are repeated to their source's target
packing      documents become pieces in sequences of at most 4096 tokens

Nulls: a null text is scored, kept and packed as an empty one; a null doc_id is kept by every stage; a null source is
a source of its own. Equal rows pass each stage alike. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactum.llm import line_dedup, minhash, mixing, packing, toxicity
from pactum.llm.queries import VOCABULARY
from pactum.llm.shared import written
from pactum.session import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained model and alignments decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
