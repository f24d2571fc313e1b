"""Streams run to completion on files and agree with the batch jobs."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from pactum.operators import ops
from pactum.operators.rule_table import default_rules
from pactum.plans.rate import rate_layouts
from pactum.sources import tables
from pactum.streaming import jobs
from pactum.workload.views import load

START = dt.datetime(2024, 1, 1)


def feed(spark, rows, schema, parts=3):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def events(n=60):
    return [(i, START + dt.timedelta(minutes=40 * i), i % 3, "upload" if i % 4 else "view") for i in range(n)]


def test_acceptance_equals_batch(spark):
    rows = events()
    stream = feed(spark, rows, jobs.EVENT_SCHEMA)
    got = {(r.event_id, r.accepted) for r in drain(jobs.accept_uploads(stream, 3), "acc")}
    batch = ops.accept_uploads(spark.createDataFrame(rows, jobs.EVENT_SCHEMA), 3)
    assert got == {(r.event_id, r.accepted) for r in batch.collect()}


def test_request_window(spark):
    rows = [(i, START + dt.timedelta(seconds=s), 1, "view") for i, s in enumerate([0, 10, 20, 59, 60, 61])]
    stream = feed(spark, rows, jobs.EVENT_SCHEMA, 2)
    got = {r.event_id: r.retry_after_seconds for r in drain(jobs.request_window(stream, 2, 60_000), "req")}
    assert got == {0: 0, 1: 0, 2: 40, 3: 1, 4: 0, 5: 0}


def test_status_feed_and_latest_equal_batch(spark):
    schema = "rating_id long, status string, at timestamp, seq long"
    path = ["queued", "queued", "extracting", "analysing", "analysing", "done", "queued"]
    rows = [(k, path[(i + k) % 7], START + dt.timedelta(minutes=i), i * 10 + k) for i in range(7) for k in range(4)]
    batch = spark.createDataFrame(rows, schema)
    got = {(r.rating_id, r.status, r.seq) for r in drain(jobs.status_feed(feed(spark, rows, schema)), "sta")}
    assert got == {(r.rating_id, r.status, r.seq) for r in ops.status_changes(batch).collect()}
    last = drain(jobs.latest_status(feed(spark, rows, schema)), "lat", "complete")
    assert {tuple(r) for r in last} == {(r.rating_id, r.status) for r in ops.latest_status(batch).collect()}


def test_late_and_duplicate_events(spark):
    rows = events(40)
    late = (99, START, 1, "view")
    stream = feed(spark, [*rows[:20], rows[5], *rows[20:], rows[38], late], jobs.EVENT_SCHEMA, 2)
    got = [r.event_id for r in drain(jobs.clean_events(stream), "cln")]
    assert len(got) == len(set(got)) and 38 in got


def test_counts_in_windows(spark):
    rows = events(60) + [(1000, START + dt.timedelta(days=30), 0, "view")]
    got = {(r.window_start, r.user_id, r.action, r.n) for r in drain(jobs.audit_counts(feed(spark, rows, jobs.EVENT_SCHEMA, 2)), "cnt")}
    batch = ops.audit_counts(spark.createDataFrame(rows, jobs.EVENT_SCHEMA))
    closed = batch.where(F.col("window_start") < F.lit(START + dt.timedelta(days=29)))
    assert got == {(r.window_start, r.user_id, r.action, r.n) for r in closed.collect()}


def test_published_batches_add_up(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = lambda *r: spark.createDataFrame(r, "contract_id long, v string")
    tables.publish(rows((1, "a"), (2, "a"), (2, "b")), root, 0)
    tables.publish(rows((3, "c")), root, 1)
    tables.publish(rows((3, "d"), (2, "z")), root, 2)
    tables.publish(rows((3, "c")), root, 1)  # a replay
    assert sorted(map(tuple, tables.current(spark, root).collect())) == [(1, "a"), (2, "z"), (3, "d")]


def test_rating_stream_equals_batch(spark):
    import pactum.workload.q_layout  # noqa: F401  (defines the layout views)

    words = load(spark, "/root/testdata/sf0.001", "contract_words").where("doc_id < 5").cache()
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for ids in ("doc_id < 2", "doc_id = 2", "doc_id >= 3", "doc_id = 1"):  # the last one is rated again
        words.where(ids).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = jobs.rate_stream(stream, default_rules(), "2024-06-01", f"{root}/out", f"{root}/check")
    assert query.awaitTermination(400)
    rating, _ = rate_layouts(words, default_rules(), "2024-06-01")
    for name in ("findings", "scores", "status"):
        got = tables.current(spark, f"{root}/out/{name}")
        assert sorted(map(str, got.collect())) == sorted(map(str, getattr(rating, name).select(got.columns).collect())), name


def test_rating_names_its_source_once(spark):
    import pactum.workload.q_layout  # noqa: F401  (defines the layout views)

    words = load(spark, "/root/testdata/sf0.001", "contract_words").where("doc_id < 2")
    rating, _ = rate_layouts(words, default_rules(), "2024-06-01")
    for name in jobs.RATING_TABLES:
        plan = getattr(rating, name)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 6 and "customer" not in plan, name


HISTORY = "rating_id long, status string, at timestamp, seq long"


def run(df, name, mode="append"):
    """All rows a stream gives, and the rows its state holds in the end."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def minutes(*rows):
    return [(key, status, START + dt.timedelta(minutes=m), n) for n, (key, status, m) in enumerate(rows)]


def test_state_of_idle_users_and_closed_windows_goes(spark):
    busy = [(i, START + dt.timedelta(minutes=i), i, "upload") for i in range(20)]
    later = [(100 + i, START + dt.timedelta(days=3, minutes=i), 99, "upload") for i in range(4)]
    _, one = run(jobs.accept_uploads(feed(spark, busy, jobs.EVENT_SCHEMA, 1), 3), "idle_before")
    _, two = run(jobs.accept_uploads(feed(spark, busy + later, jobs.EVENT_SCHEMA, 6), 3), "idle_after")
    assert two < one / 4
    rows, left = run(jobs.request_window(feed(spark, busy + later, jobs.EVENT_SCHEMA, 6), 2, 60_000), "window_after")
    assert len(rows) == 24 and left < one / 4


def test_feed_stops_after_ten_minutes_and_is_forgotten(spark):
    rows = minutes((1, "queued", 0), (2, "queued", 0), (1, "extracting", 4), (2, "extracting", 9), (1, "done", 11), (2, "done", 9.5))
    later = minutes((3, "queued", 3000), (3, "done", 3001), (1, "queued", 3002))
    got, left = run(jobs.status_feed(feed(spark, rows + later, HISTORY, 3), "1 minute"), "feed_stops")
    assert {(r.rating_id, r.status) for r in got} == {
        (1, "queued"), (1, "extracting"), (2, "queued"), (2, "extracting"), (2, "done"), (3, "queued"), (3, "done"),
    }
    _, before = run(jobs.status_feed(feed(spark, rows, HISTORY, 2), "1 minute"), "feed_before")
    assert left <= before


def test_live_status_is_the_batch_s_and_ends(spark):
    rows = minutes((1, "queued", 0), (1, "extracting", 2), (2, "queued", 3), (2, "failed", 1), (1, "done", 5), (3, "queued", 6))
    got, _ = run(jobs.live_status(feed(spark, rows, HISTORY, 2)), "live", "update")
    last = {r.rating_id: r.status for r in sorted(got, key=lambda r: r.at)}
    assert last == {r.rating_id: r.status for r in ops.latest_status(spark.createDataFrame(rows, HISTORY)).collect()}
    _, left = run(jobs.live_status(feed(spark, rows + minutes((9, "queued", 9000), (9, "done", 9001)), HISTORY, 4)), "live_end", "update")
    _, before = run(jobs.live_status(feed(spark, rows, HISTORY, 1)), "live_before", "update")
    assert left < before


def test_ratings_without_news_are_failed(spark):
    rows = minutes(
        (1, "queued", 0), (1, "extracting", 1), (2, "queued", 0), (2, "extracting", 1), (2, "analysing", 20), (2, "done", 50),
        (3, "queued", 0), (4, "queued", 5), (4, "extracting", 10), (4, "extracting", 60), (5, "queued", 100), (5, "analysing", 101),
        (9, "queued", 110),
    )
    rows.sort(key=lambda r: (r[2], r[3]))  # late rows would be dropped
    end = [(9, "extracting", START + dt.timedelta(hours=25, minutes=30), 98), (9, "done", START + dt.timedelta(hours=25, minutes=31), 99)]
    got, _ = run(jobs.stuck_ratings(feed(spark, rows + end, HISTORY, 5), "1 minute"), "stuck")
    history = spark.createDataFrame(rows + end, HISTORY)
    latest = ops.latest_status(history).select("rating_id", "status")
    times = history.groupBy("rating_id").agg(
        F.min("at").alias("created_at"),
        F.coalesce(F.max(F.when(F.col("status") == "extracting", F.col("at"))), F.min(F.when(F.col("status") == "analysing", F.col("at")))).alias("started_at"),
    )
    failed = ops.fail_stuck(times.join(latest, "rating_id"), F.lit(START + dt.timedelta(hours=25, minutes=30)))
    assert {r.rating_id for r in got} == {r.rating_id for r in failed.collect()} == {1, 3, 4, 5}
    due = {r.rating_id: r.due_at for r in got}
    assert due[4] == START + dt.timedelta(minutes=120) and due[3] == START + dt.timedelta(days=1)
    assert {(r.status, r.error_code, r.error) for r in got} == {("failed", "timeout", ops.TIMEOUT_MESSAGE)}


def test_batches_are_compacted_into_a_snapshot(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = lambda *r: spark.createDataFrame(list(r), "contract_id long, v string")
    for n in range(6):
        tables.publish(rows((n, f"own {n}"), (100, f"shared {n}")), root, n)
    reader = tables.current(spark, root)
    assert tables.compact(spark, root) == 5
    assert len(reader.collect()) == 7  # a reader that began before is unharmed
    whole = [*((n, f"own {n}") for n in range(6)), (100, "shared 5")]
    got = tables.current(spark, root)
    assert sorted(map(tuple, got.collect())) == whole
    assert not any("batch=" in f for f in got.inputFiles())
    tables.publish(rows((2, "again"), (200, "new")), root, 6)
    tables.publish(rows((0, "own 0"), (100, "shared 0")), root, 0)  # a replay of a batch in the snapshot
    want = sorted([*((n, f"own {n}") for n in range(6) if n != 2), (2, "again"), (100, "shared 5"), (200, "new")])
    assert sorted(map(tuple, tables.current(spark, root).collect())) == want
    assert {f.split("batch=")[1][0] for f in tables.current(spark, root).inputFiles() if "batch=" in f} == {"6"}
    assert tables.compact(spark, root) == 6 and tables.compact(spark, root) == 6
    assert sorted(map(tuple, tables.current(spark, root).collect())) == want
