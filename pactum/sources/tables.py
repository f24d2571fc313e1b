"""Result tables: replace by rating, upserts, appends.

Parquet has no row updates, so a table is rewritten as *old rows not touched* plus *new rows*
into a fresh folder. A stream's results are kept by batch, and a list of committed batches says
which count. A replay gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, live: DataFrame, key: str = "rating_id") -> DataFrame:
    """Old rows of ratings without a new result, and the new rows of ratings that still exist."""
    alive = live.select(key).distinct()
    fresh = new.join(alive, key, "left_semi")
    done = fresh.select(key).distinct()
    return old.join(done, key, "left_anti").unionByName(fresh)


def upsert_corpus(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus table after an ingest, and one row per changed id (``upserted, removed``).

    Rows of an ingested version that are not in the new set go; other versions stay.
    """
    versions = new.select("law_version").distinct()
    kept = old.join(versions, "law_version", "left_anti")
    removed = old.join(versions, "law_version", "left_semi").join(new.select("id"), "id", "left_anti")
    changes = new.select("id", F.lit("upserted").alias("change")).unionByName(
        removed.select("id", F.lit("removed").alias("change"))
    )
    return kept.join(new.select("id"), "id", "left_anti").unionByName(new), changes


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], at: str = "created_at") -> DataFrame:
    """Last write wins per key, as one aggregation with map-side combine."""
    stacked = old.unionByName(new)
    rest = [c for c in stacked.columns if c not in keys]
    newest = F.max(F.struct(at, *[c for c in rest if c != at])).alias("_r")
    return stacked.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written to a path and read from there: what builds on them does not compute them again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, root: str, batch: int) -> None:
    """Adds the result of a batch to a table. A replayed batch replaces its own rows.

    The rows are written first and the batch is named committed after that, in one new file, so a
    reader never sees half a write; older batches are not rewritten.
    """
    df.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
    commit = df.sparkSession.createDataFrame([(batch,)], "batch long").coalesce(1)
    commit.write.mode("append").parquet(f"{root}/commits")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _newest_snapshot(spark: SparkSession, root: str) -> int | None:
    """The last batch that a committed snapshot holds."""
    if not _exists(spark, f"{root}/snapshot_commits"):
        return None
    return spark.read.parquet(f"{root}/snapshot_commits").agg(F.max("batch")).first()[0]


def _committed_after(spark: SparkSession, root: str, batch: int | None) -> tuple[DataFrame | None, int | None]:
    """Rows of committed batches after one, with their ``batch``, and the last of these: only their folders are read."""
    commits = spark.read.parquet(f"{root}/commits").distinct()
    numbers = [r.batch for r in (commits if batch is None else commits.where(F.col("batch") > batch)).collect()]
    if not numbers:
        return None, None
    rows = spark.read.option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/batch={n}" for n in sorted(numbers)])
    return rows.withColumn("batch", F.col("batch").cast("long")), max(numbers)


def _merged(spark: SparkSession, root: str, upto: int | None, rows: DataFrame | None, key: str) -> DataFrame:
    """A snapshot's rows but for keys that later batches rate again, and these batches' rows, of each key the latest."""
    snapshot = None if upto is None else spark.read.parquet(f"{root}/snapshots/upto={upto}")
    if rows is None:
        return snapshot
    latest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    tail = rows.join(latest, [key, "batch"], "left_semi").drop("batch")
    return tail if snapshot is None else snapshot.join(latest.select(key), key, "left_anti").unionByName(tail)


def current(spark: SparkSession, root: str, key: str = "contract_id") -> DataFrame:
    """The rows of all committed batches; of a key rated again, those of its latest batch only.

    Reads the newest snapshot, if there is one, and the batches after it.
    """
    upto = _newest_snapshot(spark, root)
    return _merged(spark, root, upto, _committed_after(spark, root, upto)[0], key)


def compact(spark: SparkSession, root: str, key: str = "contract_id") -> int | None:
    """Writes what :func:`current` reads into one snapshot and names it committed; gives the last batch that it holds.

    The snapshot stands beside the batches, so readers go on meanwhile, and one that has begun keeps its files. A batch
    that is committed while this runs stays in the tail. A replay of an older batch gives the same rows again and is not
    read. Run it every so many batches: that bounds the tail, whose batch numbers the driver reads.
    """
    before = _newest_snapshot(spark, root)
    rows, upto = _committed_after(spark, root, before)
    if rows is None:
        return before
    _merged(spark, root, before, rows, key).write.mode("overwrite").parquet(f"{root}/snapshots/upto={upto}")
    spark.createDataFrame([(upto,)], "batch long").coalesce(1).write.mode("append").parquet(f"{root}/snapshot_commits")
    return upto
