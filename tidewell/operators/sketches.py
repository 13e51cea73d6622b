"""Reports over any period from stored sketches: a small row per tenant and day, or stage and day, that merge.

Days are counted once, when they are over; a period's report reads their sketches only. Distinct counts come from
HyperLogLog sketches (16,384 registers: about 1 percent of error, exact for a few), quantiles from KLL sketches
(k of 800: a rank within about half a percent). Dates are inclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS, KLL_K = 14, 800


def visitor_sketches(usage: DataFrame) -> DataFrame:
    """(tenant_id, day, visitors): a sketch of each tenant's visitors of a UTC day; null visitors don't count."""
    return usage.groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(F.hll_sketch_agg("visitor_id", F.lit(REGISTERS)).alias("visitors"))


def visitors_between(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """(tenant_id, visitors) of a period from ``visitor_sketches``, tenants without a day in it left out."""
    rows = sketches.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.groupBy("tenant_id").agg(F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors"))


def latency_sketches(stages: DataFrame) -> DataFrame:
    """(stage, day, ms, max_ms): a quantile sketch of each stage's times of a UTC day; null times don't count."""
    rows = stages.filter(F.col("ms").isNotNull()).withColumn("ms", F.col("ms").cast("double"))
    return rows.groupBy("stage", F.to_date("created_at").alias("day")).agg(F.kll_sketch_agg_double("ms", F.lit(KLL_K)).alias("ms"), F.max("ms").alias("max_ms"))


def latency_between(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """(stage, calls, p50_ms, p95_ms, max_ms) of a period from ``latency_sketches``; calls and maximum are exact."""
    rows = sketches.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    own = rows.groupBy("stage").agg(F.kll_merge_agg_double("ms").alias("ms"), F.max("max_ms").alias("max_ms"))
    quantile = lambda rank: F.kll_sketch_get_quantile_double("ms", F.lit(rank))
    return own.select("stage", F.kll_sketch_get_n_double("ms").alias("calls"), quantile(0.5).alias("p50_ms"), quantile(0.95).alias("p95_ms"), "max_ms")
