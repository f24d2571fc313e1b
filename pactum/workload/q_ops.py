"""Operational queries over the event views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.operators import ops, report
from pactum.workload.registry import query
from pactum.workload.views import load, oracle, view

NOW = "2024-01-15 00:00:00"
LATER = "2024-02-10 00:00:00"
LIMIT = 3


@view("status_history", ("events",))
def _status_history(d: str) -> str:
    return """SELECT user_id*100 + event_id%7 AS rating_id, CASE event_id%11 WHEN 0 THEN 'queued' WHEN 1 THEN 'queued' WHEN 2 THEN 'extracting' WHEN 3 THEN 'extracting' WHEN 4 THEN 'analysing' WHEN 5 THEN 'analysing' WHEN 6 THEN 'analysing'
 WHEN 7 THEN 'queued' WHEN 8 THEN 'extracting' WHEN 9 THEN 'done' ELSE 'failed' END AS status, ts AS at, event_id AS seq FROM @events@"""


def now(value: str = NOW):
    return F.lit(value).cast("timestamp")


@query(
    "quota_24h",
    oracle(("audit_events",), f"""SELECT event_id, user_id, "at", uploads, CASE WHEN uploads>={LIMIT} THEN CAST(greatest(1, ceil((epoch_us(oldest)+86400000000-epoch_us("at"))/1000000.0)) AS BIGINT) END AS retry_after_seconds FROM
 (SELECT event_id, user_id, "at", count(*) OVER w AS uploads, min("at") OVER w AS oldest FROM audit_events WHERE action='upload'
 WINDOW w AS (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW))"""),
)
def quota_24h(spark: SparkSession, sf: str) -> DataFrame:
    return ops.upload_quota(load(spark, sf, "audit_events"), LIMIT)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_TURNS = """, turns AS (SELECT event_id, user_id, "at", epoch_us("at") AS us, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS turn FROM audit_events WHERE {where})"""


@query(
    "quota_accept",
    recursive(oracle(("audit_events",), _TURNS.format(where="action='upload'") + """, folded AS (
 SELECT event_id, user_id, "at", turn, [us] AS taken, true AS accepted FROM turns WHERE turn=1
 UNION ALL SELECT event_id, user_id, "at", turn, CASE WHEN len(kept) < 1 THEN list_append(kept, us) ELSE kept END, len(kept) < 1 FROM (
  SELECT t.*, list_filter(f.taken, lambda x: x > t.us - 86400000000) AS kept FROM folded f JOIN turns t ON t.user_id=f.user_id AND t.turn=f.turn+1))
SELECT event_id, user_id, "at", accepted FROM folded""")),
)
def quota_accept(spark: SparkSession, sf: str) -> DataFrame:
    return ops.accept_uploads(load(spark, sf, "audit_events"), 1)


@query(
    "request_window_anchored",
    recursive(oracle(("audit_events",), _TURNS.format(where="true") + """, folded AS (
 SELECT event_id, user_id, "at", turn, us AS opened, 1 AS n, CAST(0 AS BIGINT) AS retry_after_seconds FROM turns WHERE turn=1
 UNION ALL SELECT t.event_id, t.user_id, t."at", t.turn, CASE WHEN t.us - f.opened >= 7200000000 THEN t.us ELSE f.opened END,
  CASE WHEN t.us - f.opened >= 7200000000 THEN 1 WHEN f.n >= 2 THEN f.n ELSE f.n + 1 END,
  CASE WHEN t.us - f.opened < 7200000000 AND f.n >= 2 THEN CAST(ceil((f.opened + 7200000000 - t.us) / 1000000) AS BIGINT) ELSE 0 END
 FROM folded f JOIN turns t ON t.user_id=f.user_id AND t.turn=f.turn+1)
SELECT event_id, user_id, "at", retry_after_seconds FROM folded""")),
)
def request_window_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return ops.request_windows(load(spark, sf, "audit_events"), 2, 7_200_000_000)


@query("request_window", oracle(("audit_events",), '''SELECT user_id, time_bucket(INTERVAL 1 HOUR, "at") AS window_start, CAST(count(*) AS BIGINT) AS requests, CAST(greatest(0, count(*)-2) AS BIGINT) AS refused FROM audit_events GROUP BY 1,2'''))
def request_window(spark: SparkSession, sf: str) -> DataFrame:
    return ops.request_counts(load(spark, sf, "audit_events"), 2, "1 hour")


@query(
    "status_changes",
    oracle(("status_history",), """, m AS (SELECT *, lag(status) OVER w l, coalesce(count(*) FILTER (WHERE status IN ('done','failed','needs_review')) OVER (PARTITION BY rating_id ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) e FROM status_history WINDOW w AS (PARTITION BY rating_id ORDER BY "at", seq))
SELECT rating_id, status, "at", seq FROM m WHERE e=0 AND status IS DISTINCT FROM l"""),
)
def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return ops.status_changes(load(spark, sf, "status_history"))


@query("latest_status", oracle(("status_history",), '''SELECT rating_id, arg_max(status, ("at", seq)) AS status, max("at") AS "at" FROM status_history GROUP BY 1'''))
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return ops.latest_status(load(spark, sf, "status_history"))


@query("stuck_ratings", oracle(("rating_rows",), f"SELECT rating_id, 'failed' AS status, 'timeout' AS error_code, TIMESTAMP '{NOW}' AS finished_at FROM rating_rows WHERE (status IN ('extracting','analysing') AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) OR (status='queued' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 1 DAY)"))
def stuck_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return ops.fail_stuck(load(spark, sf, "rating_rows"), now()).select("rating_id", "status", "error_code", "finished_at")


@query("retention_due", oracle(("stored_documents",), f"SELECT document_id, user_id, delete_after FROM stored_documents WHERE delete_after < TIMESTAMP '{LATER}' AND deleted_at IS NULL"))
def retention_due(spark: SparkSession, sf: str) -> DataFrame:
    return ops.due_documents(load(spark, sf, "stored_documents"), now(LATER)).orderBy("delete_after", "document_id").select(
        "document_id", "user_id", "delete_after"
    )


@query("retention_sweep", oracle(("stored_documents",), f"SELECT document_id, CASE WHEN delete_after < TIMESTAMP '{LATER}' AND deleted_at IS NULL THEN TIMESTAMP '{LATER}' ELSE deleted_at END AS deleted_at, delete_after < TIMESTAMP '{LATER}' AND deleted_at IS NULL AS audited FROM stored_documents"))
def retention_sweep(spark: SparkSession, sf: str) -> DataFrame:
    after, audit = ops.sweep(load(spark, sf, "stored_documents"), now(LATER))
    marks = audit.select(F.col("target_id").alias("document_id"), F.lit(True).alias("audited"))
    return after.join(marks, "document_id", "left").select("document_id", "deleted_at", F.coalesce("audited", F.lit(False)).alias("audited"))


_GONE = "SELECT c_custkey AS user_id FROM {t} WHERE c_nationkey = 5"


@query("erase_user", oracle(("rating_rows", "stored_documents"), f""", gone AS ({_GONE.format(t='customer')}) SELECT 'rating' AS kind, rating_id AS id, user_id FROM rating_rows WHERE user_id NOT IN (SELECT user_id FROM gone)
UNION ALL SELECT 'document', document_id, user_id FROM stored_documents WHERE user_id NOT IN (SELECT user_id FROM gone) UNION ALL SELECT 'audit', rating_id, user_id FROM rating_rows WHERE user_id IN (SELECT user_id FROM gone)"""))
def erase_user(spark: SparkSession, sf: str) -> DataFrame:
    users = spark.sql(_GONE.format(t="{customer}"), customer=load(spark, sf, "customer"))
    r, d, a = ops.erase_user(load(spark, sf, "rating_rows"), load(spark, sf, "stored_documents"), users, now())
    pick = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"), "user_id")
    return pick(r, "rating", "rating_id").unionByName(pick(d, "document", "document_id")).unionByName(pick(a, "audit", "target_id"))


@query("undo_upload", oracle(("audit_events", "rating_rows"), "SELECT event_id, user_id, action FROM audit_events a WHERE NOT (action='upload' AND event_id IN (SELECT rating_id FROM rating_rows WHERE status='failed'))"))
def undo_upload(spark: SparkSession, sf: str) -> DataFrame:
    audit = load(spark, sf, "audit_events").withColumn("target_id", F.col("event_id"))
    failed = load(spark, sf, "rating_rows").where("status = 'failed'")
    return ops.undo_uploads(audit, failed).select("event_id", "user_id", "action")


@query("audit_counts", oracle(("audit_events",), '''SELECT date_trunc('day', "at") AS window_start, user_id, action, CAST(count(*) AS BIGINT) AS n FROM audit_events GROUP BY 1,2,3'''))
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.audit_counts(load(spark, sf, "audit_events"))


@query(
    "reading_sessions",
    oracle(("audit_events",), """, g AS (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at", event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END b FROM audit_events)
, s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY "at", event_id) sid FROM g) SELECT user_id, min("at") AS started, max("at") + INTERVAL 6 HOURS AS ended, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid"""),
)
def reading_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reading_sessions(load(spark, sf, "audit_events"), "6 hours")


@query("owner_scope", oracle(("rating_rows",), f"SELECT rating_id, user_id, status FROM rating_rows WHERE user_id IN ({_GONE.format(t='customer')})"))
def owner_scope(spark: SparkSession, sf: str) -> DataFrame:
    callers = spark.sql(_GONE.format(t="{customer}"), customer=load(spark, sf, "customer"))
    return ops.visible(load(spark, sf, "rating_rows"), callers).select("rating_id", "user_id", "status")


@query("rating_summary", oracle(("rating_rows",), '''SELECT rating_id, status, score_overall, CASE WHEN score_overall>=80 THEN 'Good' WHEN score_overall>=60 THEN 'Fair' WHEN score_overall>=40 THEN 'Weak' WHEN score_overall IS NOT NULL THEN 'Poor' END AS band, CAST(CASE status WHEN 'queued' THEN 25 WHEN 'extracting' THEN 50 WHEN 'analysing' THEN 75 ELSE 100 END AS INTEGER) AS progress FROM rating_rows'''))
def rating_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.summaries(load(spark, sf, "rating_rows"))
    return rows.select("rating_id", "status", "score_overall", "band", report.progress_percent(F.col("status")).alias("progress"))


@query("users_newest", oracle(("rating_rows",), "SELECT user_id, min(created_at) AS created_at, CAST(row_number() OVER (ORDER BY min(created_at) DESC, user_id) AS INTEGER) AS row_no FROM rating_rows GROUP BY user_id"))
def users_newest(spark: SparkSession, sf: str) -> DataFrame:
    users = load(spark, sf, "rating_rows").groupBy("user_id").agg(F.min("created_at").alias("created_at"))
    # The number shows the order to the oracle, one row per user.
    order = Window.orderBy(F.desc("created_at"), "user_id")
    return ops.users_newest_first(users).withColumn("row_no", F.row_number().over(order))


CURSOR = ("2024-01-15 00:00:00", 40)


@query("keyset_cursor", oracle(("rating_rows",), f"SELECT rating_id, created_at FROM rating_rows WHERE user_id=7 AND (created_at < TIMESTAMP '{CURSOR[0]}' OR (created_at = TIMESTAMP '{CURSOR[0]}' AND rating_id < {CURSOR[1]})) ORDER BY created_at DESC, rating_id DESC LIMIT 21"))
def keyset_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return ops.keyset_page(load(spark, sf, "rating_rows"), 7, CURSOR).select("rating_id", "created_at")


@query("erase_dependants", oracle(("rating_rows", "status_history"), f""", gone AS ({_GONE.format(t='customer')}) SELECT rating_id, status, seq FROM status_history WHERE rating_id IN (SELECT rating_id FROM rating_rows WHERE user_id NOT IN (SELECT user_id FROM gone))"""))
def erase_dependants(spark: SparkSession, sf: str) -> DataFrame:
    users = spark.sql(_GONE.format(t="{customer}"), customer=load(spark, sf, "customer"))
    left, _, _ = ops.erase_user(load(spark, sf, "rating_rows"), load(spark, sf, "stored_documents"), users, now())
    return ops.erase_dependants(load(spark, sf, "status_history"), left).select("rating_id", "status", "seq")


@query("keyset_page", oracle(("rating_rows",), '''SELECT user_id, rating_id, created_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, rating_id DESC) AS INTEGER) AS row_no FROM rating_rows QUALIFY row_no <= 21'''))
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return ops.first_pages(load(spark, sf, "rating_rows")).select("user_id", "rating_id", "created_at", "row_no")


@query("rating_document", oracle(("rating_rows", "stored_documents"), "SELECT r.rating_id, coalesce(d.document_id IS NOT NULL AND d.deleted_at IS NULL, false) AS available, d.deleted_at FROM rating_rows r LEFT JOIN stored_documents d ON d.document_id=r.rating_id AND d.user_id=r.user_id"))
def rating_document(spark: SparkSession, sf: str) -> DataFrame:
    ratings = load(spark, sf, "rating_rows").withColumn("document_id", F.col("rating_id"))
    return report.rating_documents(ratings, load(spark, sf, "stored_documents")).select("rating_id", "available", "deleted_at")


@query("keys_revoke", """SELECT key_id, user_id FROM (SELECT s_suppkey AS key_id, s_nationkey AS nation, CAST(s_suppkey%150 AS BIGINT) AS user_id FROM supplier) WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey=5)""")
def keys_revoke(spark: SparkSession, sf: str) -> DataFrame:
    keys = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key_id"), (F.col("s_suppkey") % 150).alias("user_id"))
    users = spark.sql(_GONE.format(t="{customer}"), customer=load(spark, sf, "customer"))
    return ops.revoke_keys(keys, users).select("key_id", "user_id")
