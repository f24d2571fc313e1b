"""Operational jobs over audit events, ratings and stored documents (batch)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.operators.score import band_for

# Fixed values.
DAY_US = 86_400_000_000
PAGE_SIZE = 20
FINAL_STATUSES = ("done", "failed", "needs_review")
TIMEOUT_MESSAGE = "Rating this contract took too long and was stopped. Please upload it again."


def _uploads(events: DataFrame) -> DataFrame:
    return events.where("action = 'upload'").select("event_id", "user_id", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))


def upload_quota(events: DataFrame, limit: int) -> DataFrame:
    """For each upload: uploads of its user in the 24 hours up to it, and the wait when full.

    An upload is copied into its own day and the next, so a busy user is spread over days and every 24-hour range lies
    inside one (user, day). There the uploads meet one probe for each upload of the day, set 24 hours before it. Both
    kinds are sorted together once in either direction: a running count gives the uploads up to each row, and the least
    time seen from the late end is the oldest that still counts. So a day costs its rows, not their square.
    """
    day = F.floor(F.col("us") / DAY_US)
    probe = lambda us, is_probe: F.struct(us.alias("us"), F.lit(is_probe).alias("probe"))
    own = _uploads(events).withColumn("own", day)
    rows = own.select(
        "event_id", "user_id", "at", F.col("us").alias("upload_us"), "own",
        F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("day"),
    ).withColumn(
        "row", F.explode(F.when(
            F.col("day") == F.col("own"), F.array(probe(F.col("upload_us"), False), probe(F.col("upload_us") - DAY_US, True))
        ).otherwise(F.array(probe(F.col("upload_us"), False))))
    ).select("*", "row.us", "row.probe")
    by_day = Window.partitionBy("user_id", "day")
    up_to = by_day.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    after = by_day.orderBy(F.desc("us"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({
        "up_to": F.count_if(~F.col("probe")).over(up_to), "next": F.min(F.when(~F.col("probe"), F.col("us"))).over(after),
    }).where("day = own")
    # Rows of an upload share its partition by user and day: no further shuffle.
    counted = seen.groupBy("user_id", "day", "event_id", "at", "upload_us").agg(
        (F.max(F.when(~F.col("probe"), F.col("up_to"))) - F.max(F.when(F.col("probe"), F.col("up_to")))).alias("uploads"),
        F.max(F.when(F.col("probe"), F.col("next"))).alias("oldest"),
    )
    wait = F.greatest(F.lit(1), F.ceil((F.col("oldest") + DAY_US - F.col("upload_us")) / 1_000_000)).cast("bigint")
    return counted.select(
        "event_id", "user_id", "at", "uploads", F.when(F.col("uploads") >= limit, wait).alias("retry_after_seconds")
    )


def cut_at_gaps(rows: DataFrame, gap_us: int) -> DataFrame:
    """Rows (user_id, us, ...) with ``segment``: a user's rows up to the next pause of ``gap_us`` or more.

    Rows within a stretch of ``gap_us`` cannot be that far apart, so pauses are found between stretches: the window
    runs over one row for each user and stretch, and rows of a busy user are never sorted for it.
    """
    placed = rows.withColumn("stretch", F.floor(F.col("us") / gap_us))
    ends = placed.groupBy("user_id", "stretch").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    in_order = Window.partitionBy("user_id").orderBy("stretch")
    paused = F.coalesce(F.col("first") - F.lag("last").over(in_order) >= gap_us, F.lit(True))
    segments = ends.withColumn("starts", F.when(paused, F.col("first"))).select(
        "user_id", "stretch", F.max("starts").over(in_order).alias("segment")
    )
    return placed.join(segments, ["user_id", "stretch"]).drop("stretch")


def _folded(rows: DataFrame, start: Callable[[], Any], step: Callable[[Any, int], tuple[Any, Any]], column: str) -> DataFrame:
    """Rows (event_id, user_id, us, segment) with ``column``: each segment read in order of time, its state by ``step``.

    A task reads its sorted partition as a stream and holds one segment's state, whatever the segment's length.
    """
    name = column.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for user, segment, us in zip(batch["user_id"].tolist(), batch["segment"].tolist(), batch["us"].tolist(), strict=True):
                if (user, segment) != current:
                    current, state = (user, segment), start()
                state, value = step(state, us)
                out.append(value)
            yield batch[["event_id", "user_id", "us"]].assign(**{name: out})

    ordered = rows.select("event_id", "user_id", "us", "segment").repartition("user_id", "segment").sortWithinPartitions(
        "user_id", "segment", "us", "event_id"
    )
    return ordered.mapInPandas(run, f"event_id long, user_id long, us long, {column}").select(
        "event_id", "user_id", F.timestamp_micros("us").alias("at"), name
    )


def accept_uploads(events: DataFrame, limit: int) -> DataFrame:
    """Uploads accepted in arrival order, at most ``limit`` in 24 hours; refused ones do not count.

    Acceptance depends on earlier acceptances, but on none from before a pause of 24 hours: each user's uploads are cut
    there, and the segments are independent. The state of one is at most ``limit`` times.
    """

    def step(taken: deque, us: int) -> tuple[deque, bool]:
        while taken and taken[0] <= us - DAY_US:
            taken.popleft()
        accepted = len(taken) < limit
        if accepted:
            taken.append(us)
        return taken, accepted

    return _folded(cut_at_gaps(_uploads(events), DAY_US), deque, step, "accepted boolean")


def request_windows(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Each request's wait in seconds, 0 if it counts: a user's window opens with the first request after the last closed.

    A pause as long as the window closes any, so requests are cut there and the segments are independent.
    """

    def step(window: tuple[int | None, int], us: int) -> tuple[tuple[int, int], int]:
        opened, count = window
        if opened is None or us - opened >= window_us:
            return (us, 1), 0
        if count >= limit:
            return window, -(-(opened + window_us - us) // 1_000_000)
        return (opened, count + 1), 0

    rows = events.select("event_id", "user_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    return _folded(cut_at_gaps(rows, window_us), lambda: (None, 0), step, "retry_after_seconds long")


def request_counts(events: DataFrame, limit: int, width: str = "1 minute") -> DataFrame:
    """Requests per user and tumbling window, with how many are over the limit."""
    grouped = events.groupBy("user_id", F.window("at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return grouped.select(
        "user_id", F.col("w.start").alias("window_start"), "requests",
        F.greatest(F.lit(0), F.col("requests") - limit).alias("refused"),
    )


def status_changes(history: DataFrame) -> DataFrame:
    """First status and each change of a rating, up to and with the first final one.

    ``history``: ``rating_id, status, at, seq``.
    """
    w = Window.partitionBy("rating_id").orderBy("at", "seq")
    final = F.col("status").isin(*FINAL_STATUSES)
    before = F.count_if(final).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumns({"_last": F.lag("status").over(w), "_ended": before})
    changed = ~F.col("status").eqNullSafe(F.col("_last"))
    return marked.where((F.coalesce("_ended", F.lit(0)) == 0) & changed).drop("_last", "_ended")


def fail_stuck(ratings: DataFrame, now: Column) -> DataFrame:
    """Ratings running over an hour or queued over a day, as they are after being failed."""
    running = F.col("status").isin("extracting", "analysing") & (
        F.col("started_at") < now - F.expr("INTERVAL 1 HOUR")
    )
    queued = (F.col("status") == "queued") & (F.col("created_at") < now - F.expr("INTERVAL 1 DAY"))
    return ratings.where(running | queued).withColumns(
        {
            "status": F.lit("failed"),
            "error_code": F.lit("timeout"),
            "error": F.lit(TIMEOUT_MESSAGE),
            "finished_at": now,
        }
    )


def due_documents(documents: DataFrame, now: Column) -> DataFrame:
    return documents.where((F.col("delete_after") < now) & F.col("deleted_at").isNull())


def sweep_batch(documents: DataFrame, now: Column, batch: int) -> DataFrame:
    """The batch feature, its size the caller's: the oldest due documents (a top-k, merged from per-task top-k)."""
    return due_documents(documents, now).orderBy("delete_after", "document_id").limit(batch)


def sweep(documents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """All due documents marked deleted, and the audit rows of exactly those."""
    due = (F.col("delete_after") < now) & F.col("deleted_at").isNull()
    after = documents.withColumn("deleted_at", F.when(due, now).otherwise(F.col("deleted_at")))
    audit = documents.where(due).select(
        "user_id", F.lit("auto_delete").alias("action"), F.col("document_id").alias("target_id"),
        F.lit('{"reason":"retention"}').alias("meta"), now.alias("at"),
    )
    return after, audit


def erase_user(ratings: DataFrame, documents: DataFrame, users: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings and documents without the users' rows, and one audit row per deleted rating."""
    gone = users.select("user_id").distinct()
    removed = ratings.join(gone, "user_id", "left_semi")
    audit = removed.select(
        "user_id", F.lit("delete").alias("action"), F.col("rating_id").alias("target_id"), now.alias("at")
    )
    return (
        ratings.join(gone, "user_id", "left_anti"),
        documents.join(gone, "user_id", "left_anti"),
        audit,
    )


def erase_dependants(rows: DataFrame, ratings_left: DataFrame, key: str = "rating_id") -> DataFrame:
    """Fields, clauses, boxes or findings of ratings that still exist: what erased ratings had goes with them."""
    return rows.join(ratings_left.select(F.col("rating_id").alias(key)).distinct(), key, "left_semi")


def users_newest_first(users: DataFrame) -> DataFrame:
    """The administrator's list: newest users first, ties by id."""
    return users.orderBy(F.desc("created_at"), "user_id")


def undo_uploads(audit: DataFrame, failed: DataFrame) -> DataFrame:
    """Audit rows without the upload events of failed uploads, which gives the quota back."""
    gone = failed.select(F.col("rating_id").alias("target_id"), F.lit("upload").alias("action")).distinct()
    return audit.join(gone, ["action", "target_id"], "left_anti")


def latest_status(history: DataFrame) -> DataFrame:
    """Latest status per rating. Only a struct maximum per rating is shuffled."""
    last = F.max(F.struct("at", "seq", "status"))
    rows = history.groupBy("rating_id").agg(last.alias("l"))
    return rows.select("rating_id", F.col("l.status").alias("status"), F.col("l.at").alias("at"))


def audit_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    rows = events.groupBy(F.window("at", width).alias("w"), "user_id", "action").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rows.select(F.col("w.start").alias("window_start"), "user_id", "action", "n")


def reading_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rows.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def visible(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows whose owner is among the callers (``user_id``)."""
    return rows.join(grants.select("user_id").distinct(), "user_id", "left_semi")


def summaries(ratings: DataFrame) -> DataFrame:
    return ratings.select(
        "rating_id", "status", "score_overall",
        F.when(F.col("score_overall").isNotNull(), band_for(F.col("score_overall"))).alias("band"),
        "created_at",
    )


def keyset_page(ratings: DataFrame, user_id: int, cursor: tuple | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """One caller's page, newest first, with one row more to tell whether others follow."""
    rows = ratings.where(F.col("user_id") == user_id)
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        created = F.col("created_at")
        rows = rows.where((created < at) | ((created == at) & (F.col("rating_id") < last)))
    return rows.orderBy(F.desc("created_at"), F.desc("rating_id")).limit(size + 1)


def first_pages(ratings: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """The first page of every user; only the best rows of each user leave a task."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("rating_id"))
    return ratings.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= size + 1)


def revoke_keys(keys: DataFrame, revoked: DataFrame) -> DataFrame:
    return keys.join(revoked.select("user_id").distinct(), "user_id", "left_anti")
