"""Queries of usage, quota, audit and rate reports and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import sessions as S
from tidewell.operators import sketches as K
from tidewell.operators import usage as U
from tidewell.sources.derived import frame, with_views
from tidewell.sources.shared import stored

NOW = "2024-01-31 00:00:00"


def _(function, *views, **parameters):
    return lambda spark, sf_dir: function(*[frame(spark, sf_dir, v) for v in views], **parameters)


def _stages(spark, sf_dir):
    return U.stage_latency(frame(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


def _approximate(spark, sf_dir):
    """Within four standard errors of the exact count, or not."""
    usage = frame(spark, sf_dir, "usage_records")
    near = U.approximate_visitors(usage).withColumnRenamed("visitors", "near")
    both = U.distinct_visitors(usage).join(near, "tenant_id")
    return both.select("tenant_id", "visitors", (F.abs(F.col("near") - F.col("visitors")) <= F.greatest(F.lit(2.0), F.col("visitors") * 0.08)).alias("close"))


def _retention(spark, sf_dir):
    kept, expired = U.retention_split(frame(spark, sf_dir, "usage_records"), 7, NOW)
    return kept.select("usage_id", F.lit("kept").alias("part")).union(expired.select("usage_id", F.lit("expired")))


def _visitors_between(spark, sf):
    """A period's visitors from stored days, beside the exact number and whether the two are within three percent."""
    usage = frame(spark, sf, "usage_records")
    days = stored(K.visitor_sketches(usage), "visitors")
    near = K.visitors_between(days, "2024-01-05", "2024-01-20").withColumnRenamed("visitors", "near")
    exact = U.distinct_visitors(usage.filter("created_at >= '2024-01-05' AND created_at < '2024-01-21'"))
    return exact.join(near, "tenant_id").select("tenant_id", "visitors", (F.abs(F.col("near") - F.col("visitors")) <= F.greatest(F.lit(1.0), 0.03 * F.col("visitors"))).alias("close"))


def _latency_between(spark, sf):
    """A period's latency from stored days: calls, maximum, and whether the exact ranks of its quantiles are within one percent."""
    stages = frame(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("ts").alias("created_at"))
    days = stored(K.latency_sketches(stages), "latency")
    got = K.latency_between(days, "2024-01-05", "2024-01-20")
    rows = stages.filter("created_at >= '2024-01-05' AND created_at < '2024-01-21'").join(F.broadcast(got), "stage")  # a row per stage

    def close(p, rank):  # of equal values any rank will do
        n = F.count("*")
        return (F.count_if(F.col("ms") < F.col(p)) <= (rank + 0.01) * n) & (F.count_if(F.col("ms") <= F.col(p)) >= (rank - 0.01) * n)

    return rows.groupBy("stage", "calls", "max_ms").agg((close("p50_ms", 0.5) & close("p95_ms", 0.95)).alias("close")).select("stage", "calls", "max_ms", "close")


QUERIES = {
    "usage_report": _(U.usage_report, "usage_records"),
    "tokens_by_day": _(U.tokens_by_day, "usage_records"),
    "quota_status": _(U.quota_status, "usage_records", "tenants", estimated=500),
    "platform_overview": _(U.platform_overview, "customer", "orders"),
    "tenant_list": _(U.tenant_list, "tenants", "usage_records", "audit_logs"),
    "audit_report": _(U.audit_report, "audit_logs", limit=100),
    "audit_cube": _(U.audit_cube, "audit_logs"),
    "stage_latency": _stages,
    "playground_report": _(U.playground_report, "playground_runs"),
    "newest_runs": _(U.newest_runs, "playground_runs"),
    "distinct_visitors": _(U.distinct_visitors, "usage_records"),
    "approximate_visitors": _approximate,
    "visitors_between": _visitors_between,
    "latency_between": _latency_between,
    "running_quota": _(U.running_quota, "usage_records", "tenants"),
    "request_rate": _(U.request_rate, "usage_records", seconds=3600),
    "retention_split": _retention,
    "since_days": _(S.since_days, "usage_records", days=400, now="2024-04-20 00:00:00"),
    "rate_limit_decisions": _(U.rate_limit_decisions, "usage_records", rpm=3, window_s=3600.0),
}

#: A step a request: the accepted times that are still in the window are carried along.
RATE_LIMIT_SQL = with_views("""WITH RECURSIVE x AS (SELECT tenant_id, usage_id, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, usage_id) AS n FROM usage_records),
    r AS (SELECT tenant_id, usage_id, n, [us] AS held, TRUE AS accepted FROM x WHERE n = 1
      UNION ALL SELECT tenant_id, usage_id, n, CASE WHEN len(h) < 3 THEN list_append(h, us) ELSE h END, len(h) < 3
      FROM (SELECT x.tenant_id, x.usage_id, x.n, x.us, list_filter(r.held, lambda t: x.us - t <= 3600000000) AS h FROM r JOIN x ON x.tenant_id = r.tenant_id AND x.n = r.n + 1))
    SELECT tenant_id, usage_id, accepted FROM r""", "usage_records")

ORACLE_SQL = {
    "rate_limit_decisions": RATE_LIMIT_SQL,
    "usage_report": with_views("""SELECT * FROM (SELECT tenant_id, CASE WHEN grouping(kind) = 1 THEN 'employee' ELSE 'kind' END AS section, kind, employee_id,
        CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS calls
        FROM usage_records GROUP BY GROUPING SETS ((tenant_id, kind), (tenant_id, employee_id))) WHERE section = 'kind' OR employee_id IS NOT NULL""", "usage_records"),
    "tokens_by_day": with_views("SELECT tenant_id, CAST(created_at AS DATE) AS day, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage_records GROUP BY 1, 2", "usage_records"),
    "quota_status": with_views("""WITH d AS (SELECT tenant_id, CAST(created_at AS DATE) AS day, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage_records GROUP BY 1, 2)
        SELECT tenant_id, day, tokens, daily_token_quota, CAST(printf('%.2f', CAST(tokens * 100.0 AS DOUBLE) / nullif(daily_token_quota, 0)) AS DOUBLE) AS used_percent, tokens + 500 > daily_token_quota AS exceeded
        FROM d JOIN tenants USING (tenant_id)""", "usage_records", "tenants"),
    "platform_overview": """WITH p AS (SELECT c_nationkey AS tenant_id, count(*) AS customers FROM customer GROUP BY 1),
        b AS (SELECT c_nationkey AS tenant_id, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT tenant_id, CAST(sum(customers) AS BIGINT) AS customers, CAST(sum(coalesce(orders, 0)) AS BIGINT) AS orders FROM p LEFT JOIN b USING (tenant_id) GROUP BY ROLLUP (tenant_id)""",
    "tenant_list": with_views("""SELECT t.tenant_id, name, status, coalesce(calls, 0) AS calls, coalesce(denied, 0) AS denied FROM tenants t
        LEFT JOIN (SELECT tenant_id, count(*) AS calls FROM usage_records GROUP BY 1) USING (tenant_id)
        LEFT JOIN (SELECT tenant_id, count(*) AS denied FROM audit_logs WHERE result = 'deny' GROUP BY 1) USING (tenant_id)""", "tenants", "usage_records", "audit_logs"),
    "audit_report": with_views("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, audit_id DESC) AS place FROM audit_logs) WHERE place <= 100", "audit_logs"),
    "audit_cube": with_views("SELECT action, result, count(*) AS n FROM audit_logs GROUP BY CUBE (action, result)", "audit_logs"),
    "stage_latency": """SELECT event_type AS stage, count(*) AS calls, round(avg(value), 3) AS mean_ms, round(quantile_cont(value, 0.5), 3) AS p50_ms,
        round(quantile_cont(value, 0.95), 3) AS p95_ms, max(value) AS max_ms FROM events GROUP BY 1""",
    "playground_report": with_views("""SELECT employee_id, count(*) AS runs, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS ok_rate, round(avg(score), 6) AS mean_score,
        round(avg(latency_ms), 4) AS mean_latency_ms, max(latency_ms) AS max_latency_ms, CAST(sum(tokens) AS BIGINT) AS tokens FROM playground_runs GROUP BY 1""", "playground_runs"),
    "newest_runs": with_views("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY created_at DESC, run_id DESC) AS place FROM playground_runs) WHERE place <= 200", "playground_runs"),
    "distinct_visitors": with_views("SELECT tenant_id, count(DISTINCT visitor_id) AS visitors FROM usage_records GROUP BY 1", "usage_records"),
    "visitors_between": with_views("SELECT tenant_id, count(DISTINCT visitor_id) AS visitors, TRUE AS close FROM usage_records WHERE created_at >= '2024-01-05' AND created_at < '2024-01-21' GROUP BY 1", "usage_records"),
    "latency_between": "SELECT event_type AS stage, count(*) AS calls, max(value) AS max_ms, TRUE AS close FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-21' GROUP BY 1",
    "approximate_visitors": with_views("SELECT tenant_id, count(DISTINCT visitor_id) AS visitors, TRUE AS close FROM usage_records GROUP BY 1", "usage_records"),
    "running_quota": with_views("""WITH r AS (SELECT *, CAST(created_at AS DATE) AS day, CAST(sum(total_tokens) OVER (PARTITION BY tenant_id, CAST(created_at AS DATE) ORDER BY created_at, usage_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM usage_records),
        o AS (SELECT r.*, row_number() OVER (PARTITION BY r.tenant_id, day ORDER BY created_at, usage_id) AS n FROM r JOIN tenants USING (tenant_id) WHERE running > daily_token_quota)
        SELECT tenant_id, day, usage_id, running FROM o WHERE n = 1""", "usage_records", "tenants"),
    "request_rate": with_views("SELECT usage_id, tenant_id, count(*) OVER (PARTITION BY tenant_id ORDER BY created_at RANGE BETWEEN INTERVAL '3600' SECOND PRECEDING AND CURRENT ROW) AS in_window FROM usage_records", "usage_records"),
    "retention_split": with_views(f"SELECT usage_id, CASE WHEN created_at >= TIMESTAMP '{NOW}' - INTERVAL '7' DAY THEN 'kept' ELSE 'expired' END AS part FROM usage_records", "usage_records"),
    "since_days": with_views("SELECT * FROM usage_records WHERE created_at >= TIMESTAMP '2024-04-20 00:00:00' - INTERVAL '90' DAY", "usage_records"),
}
