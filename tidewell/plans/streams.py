"""Streaming jobs as queries: the batch form of each, and the stream run over the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import sessions as S
from tidewell.operators import usage as U
from tidewell.plans.usage import RATE_LIMIT_SQL
from tidewell.sources.derived import VIEWS, _named, frame, with_views
from tidewell.sources.shared import shared_folder
from tidewell.streaming import jobs as J


def stream(spark, sf, name):
    """A view as a stream: its one table, perhaps through another view."""
    (need,), text = VIEWS[name]
    below = stream(spark, sf, need) if need in VIEWS else J.read_stream(spark, sf, need)
    return spark.sql(_named(text, (need,)), **{need: below})


def _zoned(rows):
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp"))


def _debounce(rows):
    return J.debounce_messages(_zoned(rows).filter("role = 'visitor'"), "130 seconds").withColumn("content", F.md5("content"))


def _replies(messages, spans):
    images = F.when(F.col("seq") % 3 == 0, F.array(F.concat(F.lit("a"), "seq"), F.concat(F.lit("b"), "seq")))
    spans = spans.withColumns({c: F.col(c).cast("timestamp") for c in ("from_at", "to_at")})
    rows = J.debounce_replies(_zoned(messages).filter("role = 'visitor'").withColumn("images", images), spans, "130 seconds")
    return rows.select("session_id", "first_at", F.col("n").cast("long").alias("n"), F.md5("content").alias("content"), F.array_join("images", ",").alias("images"))


def _replies_stream(spark, sf):
    """Both streams end with a row of a session of its own, a century on: the watermark then passes all other rows."""
    messages, spans = stream(spark, sf, "messages"), stream(spark, sf, "status_spans")
    last = messages.filter("session_id = 0 AND seq = 0").withColumns({"session_id": F.lit(-1).cast("long"), "role": F.lit("visitor"), "created_at": F.expr("created_at + INTERVAL '36500' DAY")})
    closing = last.select("session_id", F.lit("ai").alias("status"), F.col("created_at").alias("from_at"), F.col("created_at").alias("to_at"))
    return J.run_once(_replies(messages.unionByName(last), spans.unionByName(closing)), "replies")


def _stages(rows):
    return rows.select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("ts").cast("timestamp").alias("created_at"))


def _timing(rows):
    return J.timing_windows(_stages(rows), "1 day")


def _ingest(spark, sf):
    """Documents as a stream of files into chunk, vector and status tables, read back as each batch left them."""
    path, state = shared_folder(spark, "ingest"), shared_folder(spark, "ingest-state")
    files = J.read_stream(spark, sf, "documents").select("doc_id", F.expr("CAST(substr(source, 4) AS INT) % 4 AS tenant_id"), F.col("source").alias("kb_id"), F.expr("concat('d', doc_id, '.txt') AS filename"), "text")
    J.ingest_stream(files, path, state)
    vectors = J.ingested(spark, path, "vectors").groupBy("doc_id").agg(F.count("*").alias("vectors"))
    return J.ingested(spark, path, "status").join(vectors, "doc_id", "left").select("doc_id", "status", F.col("chunk_count").cast("long").alias("chunk_count"), F.coalesce("vectors", F.lit(0)).alias("vectors"))


def _late(spark, sf):
    """All usage rows in three deliveries, each drained by a restarted job: the second and third bring late rows."""
    path, state, at = shared_folder(spark, "late"), shared_folder(spark, "late-state"), shared_folder(spark, "late-in")
    rows = _zoned(frame(spark, sf, "usage_records"))
    for delivery in range(3):
        rows.filter(F.col("usage_id") % 3 == delivery).write.mode("append").parquet(at)
        J.count_late(spark.readStream.schema(rows.schema).parquet(at), path, state, 3600)
    return J.late_counts(spark, path)


QUERIES = {
    "debounce_messages": lambda s, d: _debounce(frame(s, d, "messages")),
    "debounce_messages_stream": lambda s, d: J.run_once(_debounce(stream(s, d, "messages")), "debounce", "complete"),
    "debounce_replies": lambda s, d: _replies(frame(s, d, "messages"), frame(s, d, "status_spans")),
    "debounce_replies_stream": _replies_stream,
    "dedupe_uploads_stream": lambda s, d: J.run_once(J.dedupe_stream(_zoned(stream(s, d, "uploads")).select("tenant_id", "kb_id", "filename", "size_bytes", "created_at")), "dedupe").drop("created_at"),
    "timing_windows_stream": lambda s, d: J.run_once(_timing(J.read_stream(s, d, "events")), "timing", "complete"),
    "ingest_stream": _ingest,
    "late_counts": _late,
    "usage_windows": lambda s, d: J.usage_windows(_zoned(frame(s, d, "usage_records"))),
    "usage_windows_stream": lambda s, d: J.run_once(J.usage_windows(_zoned(stream(s, d, "usage_records"))), "usage", "complete"),
    "rate_windows": lambda s, d: J.rate_windows(_zoned(frame(s, d, "usage_records")), "1 hour", "20 minutes"),
    "rate_windows_stream": lambda s, d: J.run_once(J.rate_windows(_zoned(stream(s, d, "usage_records")), "1 hour", "20 minutes"), "rate", "complete"),
    "timing_windows": lambda s, d: _timing(s.read.parquet(f"{d}/events.parquet")),
    "rate_limit_stream": lambda s, d: J.run_once(J.rate_limit_stream(_zoned(stream(s, d, "usage_records")), 3, 3600.0), "limit"),
    "response_time_stream": lambda s, d: J.run_once(J.response_time_stream(_zoned(stream(s, d, "messages"))), "response"),
    "response_cycles": lambda s, d: S.response_cycles(frame(s, d, "messages")),
    "session_state_stream": lambda s, d: J.run_once(J.session_state_stream(_zoned(stream(s, d, "messages"))), "state"),
    "dedupe_uploads": lambda s, d: J.dedupe_stream(frame(s, d, "uploads")).select("tenant_id", "kb_id", "filename", "size_bytes"),
    "quota_alerts": lambda s, d: J.quota_alerts(J.usage_windows(_zoned(frame(s, d, "usage_records"))), frame(s, d, "tenants")).select("tenant_id", F.to_date("start").alias("day"), "tokens"),
    "offered_load": lambda s, d: U.request_rate(frame(s, d, "usage_records"), 60).filter("in_window > 1"),
}

_USAGE = with_views("SELECT date_trunc('day', created_at) AS start, tenant_id, kind, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM usage_records GROUP BY 1, 2, 3", "usage_records")
_RATE = with_views("""SELECT time_bucket(INTERVAL '20' MINUTE, created_at) - k * INTERVAL '20' MINUTE AS start, tenant_id, count(*) AS requests
    FROM usage_records, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) GROUP BY 1, 2""", "usage_records")
_CYCLES = with_views("""WITH c AS (SELECT tenant_id, session_id, cycle, min(CASE WHEN role = 'visitor' THEN created_at END) AS asked, min(CASE WHEN role <> 'visitor' THEN created_at END) AS answered
      FROM (SELECT *, sum(CASE WHEN role <> 'visitor' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING) - CASE WHEN role <> 'visitor' THEN 1 ELSE 0 END AS cycle
            FROM messages WHERE role IN ('visitor', 'ai', 'agent')) GROUP BY 1, 2, 3)
    SELECT tenant_id, session_id, CAST(epoch(answered) - epoch(asked) AS BIGINT) AS wait_s FROM c WHERE asked IS NOT NULL AND answered IS NOT NULL""", "messages")

_DEBOUNCE = with_views("""WITH v AS (SELECT *, epoch(created_at) - epoch(lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at, seq)) AS gap FROM messages WHERE role = 'visitor'),
        i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 130 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, seq) AS island FROM v)
        SELECT session_id, min(created_at) AS first_at, count(*) AS n, md5(string_agg(content, chr(10) ORDER BY created_at, seq)) AS content FROM i GROUP BY session_id, island""", "messages")
_REPLIES = with_views("""WITH j AS (SELECT m.session_id, m.seq, m.content, m.created_at, coalesce(s.status, 'ai') <> 'ai' AS alone, CASE WHEN m.seq % 3 = 0 THEN [concat('a', m.seq), concat('b', m.seq)] ELSE [] END AS images
          FROM messages m LEFT JOIN status_spans s ON m.session_id = s.session_id AND m.created_at >= s.from_at AND m.created_at < s.to_at WHERE m.role = 'visitor'),
        g AS (SELECT *, epoch(created_at) - epoch(lag(created_at) OVER (PARTITION BY session_id, alone ORDER BY created_at, seq)) AS gap FROM j),
        i AS (SELECT *, sum(CASE WHEN alone OR gap IS NULL OR gap >= 130 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, alone ORDER BY created_at, seq) AS island FROM g)
        SELECT session_id, min(created_at) AS first_at, count(*) AS n, md5(string_agg(content, chr(10) ORDER BY created_at, seq)) AS content,
        array_to_string(list_slice(flatten(list(images ORDER BY created_at, seq)), 1, 3), ',') AS images FROM i GROUP BY session_id, alone, island""", "messages", "status_spans")
_TIMING = """SELECT date_trunc('day', ts) AS start, event_type AS stage, count(*) AS calls, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms FROM events GROUP BY 1, 2"""

ORACLE_SQL = {
    "debounce_messages": _DEBOUNCE,
    "debounce_messages_stream": _DEBOUNCE,
    "debounce_replies": _REPLIES,
    "debounce_replies_stream": _REPLIES,
    "dedupe_uploads_stream": with_views("SELECT DISTINCT tenant_id, kb_id, filename, size_bytes FROM uploads", "uploads"),
    "timing_windows_stream": _TIMING,
    "late_counts": with_views("""WITH d AS (SELECT usage_id % 3 AS k, created_at FROM usage_records), m AS (SELECT k, max(max(created_at)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d GROUP BY k)
        SELECT count(*) AS n, count(*) FILTER (WHERE floor(epoch(created_at)) < floor(epoch(before)) - 3600) AS late FROM d JOIN m USING (k)""", "usage_records"),
    "usage_windows": _USAGE,
    "usage_windows_stream": _USAGE,
    "rate_windows": _RATE,
    "rate_windows_stream": _RATE,
    "timing_windows": _TIMING,
    "rate_limit_stream": RATE_LIMIT_SQL,
    "session_state_stream": with_views("""WITH RECURSIVE x AS (SELECT session_id, seq, role, contains(content, '低置信') AS note, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS n FROM messages),
        r AS (SELECT session_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ai, CAST(0 AS BIGINT) AS visitor, CAST(0 AS BIGINT) AS clarify, CAST(0 AS BIGINT) AS streak, 'ai' AS status FROM (SELECT DISTINCT session_id FROM x)
          UNION ALL SELECT x.session_id, x.seq, x.n, ai + CASE WHEN role = 'ai' AND status = 'ai' THEN 1 ELSE 0 END, visitor + CASE WHEN role = 'visitor' THEN 1 ELSE 0 END,
          CASE WHEN role = 'ai' AND status = 'ai' THEN 0 WHEN role = 'system' AND note AND status = 'ai' THEN clarify + 1 ELSE clarify END, CASE WHEN role = 'ai' AND status = 'ai' THEN 0 WHEN role = 'system' AND note AND status = 'ai' THEN streak + 1 ELSE streak END,
          CASE WHEN role = 'system' AND note AND status = 'ai' AND streak + 1 >= 2 THEN 'queued' ELSE status END FROM r JOIN x ON x.session_id = r.session_id AND x.n = r.n + 1)
        SELECT session_id, seq, ai, visitor, clarify, streak, status FROM r WHERE n > 0""", "messages"),
    "response_time_stream": _CYCLES,
    "response_cycles": _CYCLES,
    "dedupe_uploads": with_views("SELECT DISTINCT tenant_id, kb_id, filename, size_bytes FROM uploads", "uploads"),
    "quota_alerts": with_views("""SELECT tenant_id, day, tokens FROM (SELECT tenant_id, CAST(created_at AS DATE) AS day, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage_records GROUP BY 1, 2)
        JOIN tenants USING (tenant_id) WHERE tokens > daily_token_quota""", "usage_records", "tenants"),
    "offered_load": with_views("SELECT * FROM (SELECT usage_id, tenant_id, count(*) OVER (PARTITION BY tenant_id ORDER BY created_at RANGE BETWEEN INTERVAL '60' SECOND PRECEDING AND CURRENT ROW) AS in_window FROM usage_records) WHERE in_window > 1", "usage_records"),
}
