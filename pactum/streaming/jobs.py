"""Structured Streaming forms of the operational jobs.

The batch meaning is the library's; event time, watermarks and late data are decided here:
events later than the watermark are dropped, duplicates inside it are removed by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.operators.rule_table import RuleSet
from pactum.plans.rate import rate_layouts
from pactum.sources.tables import publish
from pactum.streaming import stateful

EVENT_SCHEMA = "event_id long, at timestamp, user_id long, action string"


def clean_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Late and duplicate events removed."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def upload_quota(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Uploads per user in sliding 24-hour windows, one step an hour."""
    uploads = events.where("action = 'upload'").withWatermark("at", delay)
    grouped = uploads.groupBy(F.window("at", "24 hours", "1 hour").alias("w"), "user_id")
    rows = grouped.agg(F.count(F.lit(1)).alias("uploads"))
    return rows.select("user_id", F.col("w.end").alias("window_end"), "uploads")


def audit_counts(events: DataFrame, width: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "user_id", "action")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "user_id", "action", "n")


def accept_uploads(events: DataFrame, limit: int, delay: str = "10 minutes") -> DataFrame:
    """Accepts an upload while fewer than ``limit`` were accepted in the last 24 hours.

    The state of a user is at most ``limit`` times, and is gone a day after the last of them.
    """
    return stateful.accept_uploads(events, limit, delay)


def request_window(events: DataFrame, limit: int, window_ms: int, delay: str = "10 minutes") -> DataFrame:
    """A fixed window per user that opens with the first request after the last one closed; closed windows are forgotten."""
    return stateful.request_window(events, limit, window_ms, delay)


def status_feed(history: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First status and changes of a rating until a final one, for ten minutes at most.

    Input: ``rating_id, status, at, seq``. A closed feed is forgotten after a day.
    """
    return stateful.status_feed(history, delay)


def live_status(history: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each change of a rating's latest status; a rating is forgotten a day after the last news. Update mode."""
    return stateful.live_status(history, delay)


def stuck_ratings(history: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Ratings that no news came of in time, as failed: given out by the absence of input."""
    return stateful.stuck_ratings(history, delay)


def latest_status(history: DataFrame) -> DataFrame:
    """Latest status per rating; update mode."""
    last = F.max(F.struct("at", "seq", "status")).alias("l")
    return history.groupBy("rating_id").agg(last).select("rating_id", "l.status")


def rate_stream(words: DataFrame, rules: RuleSet, today: str, root: str, checkpoint: str):
    """Rates contracts as the files of their word boxes arrive, a contract whole in one file.

    Each batch runs :func:`rate_layouts` and adds its findings, deadlines, scores, status, reasons and
    clauses to tables below ``root`` (read them with ``tables.current``). A replayed batch replaces its own
    rows, and a contract that comes again replaces its older rating.
    """

    def rate_batch(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rating, rejected = rate_layouts(batch, rules, today, folder=f"{root}/work/batch={number}")
        for name in RATING_TABLES:
            publish(getattr(rating, name), f"{root}/{name}", number)
        publish(rejected.withColumnRenamed("doc_id", "contract_id"), f"{root}/rejected", number)

    return (
        words.writeStream.foreachBatch(rate_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


RATING_TABLES = ("findings", "deadlines", "scores", "status", "reasons", "clauses")
