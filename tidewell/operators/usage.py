"""Usage, quotas, rates, audit and latency reports."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import round_even
from tidewell.operators.folds import fold_in_order


def usage_report(usage: DataFrame) -> DataFrame:
    """Tokens and calls by tenant and kind, and by tenant and employee (rows without one left out there),
    in one pass over grouping sets."""
    sets = usage.sparkSession.sql("""
        SELECT tenant_id, kind, employee_id, grouping(kind) AS by_employee, sum(prompt_tokens) AS prompt_tokens,
               sum(completion_tokens) AS completion_tokens, sum(total_tokens) AS total_tokens, count(*) AS calls
        FROM {usage} GROUP BY GROUPING SETS ((tenant_id, kind), (tenant_id, employee_id))""", usage=usage)
    return sets.filter((F.col("by_employee") == 0) | F.col("employee_id").isNotNull()).select(
        "tenant_id", F.when(F.col("by_employee") == 1, "employee").otherwise("kind").alias("section"), "kind", "employee_id", "prompt_tokens", "completion_tokens", "total_tokens", "calls"
    )


def tokens_by_day(usage: DataFrame) -> DataFrame:
    """Tokens per tenant and UTC day."""
    return usage.groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(F.sum("total_tokens").alias("tokens"))


def quota_status(usage: DataFrame, tenants: DataFrame, estimated: int = 0) -> DataFrame:
    """Tokens of each tenant and day against its quota; the share is null where there is no quota. It is rounded as
    the double it is, not by its decimal text: 3630 of 40000 is a little less than 9.075 percent."""
    percent = F.col("tokens") * 100.0 / F.nullif("daily_token_quota", F.lit(0))
    rows = tokens_by_day(usage).join(tenants.select("tenant_id", "daily_token_quota"), "tenant_id")
    return rows.select(
        "tenant_id", "day", "tokens", "daily_token_quota",
        round_even(percent, 2).alias("used_percent"),
        (F.col("tokens") + estimated > F.col("daily_token_quota")).alias("exceeded"),
    )


def platform_overview(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Counts per tenant (here: nation of the customer) with a grand total row; each table is aggregated
    before they meet."""
    people = customers.groupBy(F.col("c_nationkey").alias("tenant_id")).agg(F.count("*").alias("customers"))
    owner = customers.select("c_custkey", F.col("c_nationkey").alias("tenant_id"))
    bought = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders")).join(owner, "c_custkey").groupBy("tenant_id").agg(F.sum("orders").alias("orders"))
    rows = people.join(bought, "tenant_id", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    return rows.rollup("tenant_id").agg(F.sum("customers").alias("customers"), F.sum("orders").alias("orders"))


def tenant_list(tenants: DataFrame, usage: DataFrame, audits: DataFrame) -> DataFrame:
    """Tenants with calls and denied actions, zero where none; name order."""
    calls = usage.groupBy("tenant_id").agg(F.count("*").alias("calls"))
    denied = audits.filter(F.col("result") == "deny").groupBy("tenant_id").agg(F.count("*").alias("denied"))
    rows = tenants.join(calls, "tenant_id", "left").join(denied, "tenant_id", "left")
    return rows.select("tenant_id", "name", "status", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("denied", F.lit(0)).alias("denied")).orderBy("name")


def audit_report(audits: DataFrame, limit: int = 100) -> DataFrame:
    """Each tenant's newest audit rows; the limit is clamped to 1..500."""
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("audit_id"))
    return audits.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= max(1, min(500, limit)))


def audit_cube(audits: DataFrame) -> DataFrame:
    return audits.cube("action", "result").agg(F.count("*").alias("n"))


def stage_latency(stages: DataFrame) -> DataFrame:
    """Calls, mean, exact median and p95, maximum per stage. Stages overlap: don't add them up."""
    return stages.groupBy("stage").agg(
        F.count("*").alias("calls"), round_even(F.avg("ms"), 3).alias("mean_ms"), round_even(F.percentile("ms", F.lit(0.5)), 3).alias("p50_ms"),
        round_even(F.percentile("ms", F.lit(0.95)), 3).alias("p95_ms"), F.max("ms").alias("max_ms"),
    )


def playground_report(runs: DataFrame) -> DataFrame:
    return runs.groupBy("employee_id").agg(
        F.count("*").alias("runs"), round_even(F.avg(F.col("ok").cast("double")), 6).alias("ok_rate"), round_even(F.avg("score"), 6).alias("mean_score"),
        round_even(F.avg("latency_ms"), 4).alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.sum("tokens").alias("tokens"),
    )


def newest_runs(runs: DataFrame, limit: int = 200) -> DataFrame:
    newest = Window.partitionBy("employee_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= max(1, min(200, limit)))


def distinct_visitors(usage: DataFrame) -> DataFrame:
    """Distinct visitors per tenant, exact; ``approximate_visitors`` is the sketch form for large periods."""
    return usage.groupBy("tenant_id").agg(F.countDistinct("visitor_id").alias("visitors"))


def approximate_visitors(usage: DataFrame, rsd: float = 0.02) -> DataFrame:
    return usage.groupBy("tenant_id").agg(F.approx_count_distinct("visitor_id", rsd).alias("visitors"))


def running_quota(usage: DataFrame, tenants: DataFrame) -> DataFrame:
    """The first row of each tenant and day at which the day's tokens pass the quota."""
    upto = Window.partitionBy("tenant_id", "day").orderBy("created_at", "usage_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = usage.withColumn("day", F.to_date("created_at")).withColumn("running", F.sum("total_tokens").over(upto))
    over = rows.join(tenants.select("tenant_id", "daily_token_quota"), "tenant_id").filter(F.col("running") > F.col("daily_token_quota"))
    first = over.groupBy("tenant_id", "day").agg(F.min(F.struct("created_at", "usage_id", "running")).alias("first"))
    return first.select("tenant_id", "day", "first.usage_id", "first.running")


def request_rate(usage: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the tenant in the trailing window at each request, by microseconds. Time is cut into pieces of
    the window's length; a piece and the one before it hold all that its requests see, so that a tenant's requests
    are as many groups of work as it has pieces."""
    width = seconds * 1_000_000
    rows = usage.select("usage_id", "tenant_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    rows = rows.withColumn("own", F.floor(F.col("at") / width))
    seen = rows.withColumn("piece", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    back = Window.partitionBy("tenant_id", "piece").orderBy("at").rangeBetween(-width, 0)
    return seen.withColumn("in_window", F.count("*").over(back)).filter(F.col("piece") == F.col("own")).select("usage_id", "tenant_id", "in_window")


def retention_split(rows: DataFrame, keep_days: int, now: str) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) rows."""
    start = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{keep_days}' DAY")
    return rows.filter(F.col("created_at") >= start), rows.filter(F.col("created_at") < start)


def rate_limit_decisions(hits: DataFrame, rpm: int = 120, window_s: float = 60.0) -> DataFrame:
    """(tenant_id, usage_id, accepted): a hit passes iff fewer than max(1, rpm) accepted hits are at most
    ``window_s`` old; refused hits don't count. Each decision needs the earlier ones, so a tenant is one
    sequential task, which streams its hits in time order and holds the accepted times still in the window;
    offered load (``request_rate``) scales freely."""

    def decide(held: deque, at: int) -> bool:
        while held and at - held[0] > window_s * 1_000_000:
            held.popleft()
        if len(held) >= max(1, rpm):
            return False
        held.append(at)
        return True

    rows = hits.select("tenant_id", "usage_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    return fold_in_order(rows, ["tenant_id"], ["at", "usage_id"], ["at"], deque, decide, "accepted", "boolean").drop("at")
