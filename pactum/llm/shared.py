"""Helpers the operators share: words, written tables, checked broadcasts, fixed hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.session import checkpoint_root

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side is broadcast only after its rows, and the elements of its arrays, were counted and found to be at most so many.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_ELEMENTS = 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, array: str | None = None) -> DataFrame:
    """A hint to broadcast an already written table, given only if its counted rows stay in bounds.

    ``array`` names a column of arrays whose elements are counted as well. A larger table is returned as it is;
    its join is then a shuffled one that can split hot keys.
    """
    elements = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    found = df.agg(F.count("*").alias("rows"), elements.alias("elements")).first()
    fits = found.rows <= MAX_BROADCAST_ROWS and found.elements <= MAX_BROADCAST_ELEMENTS
    return F.broadcast(df) if fits else df


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what a task holds beside its input stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """At the end of a task: its worker lives on, beside those of later work, so the memory it has freed goes back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of the parts: equal in every engine and run."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
