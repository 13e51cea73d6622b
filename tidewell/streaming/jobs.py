"""Streaming jobs: plain functions from frames to frames that work on streams and, without state functions,
on tables alike. Event-time jobs state their watermark; ``run_once`` drains what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.shared import shared_folder
from tidewell.streaming.ingest import ingest_stream, ingested  # noqa: F401
from tidewell.streaming.keyed import rate_limit_stream, response_time_stream, session_state_stream  # noqa: F401


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and read back what it wrote. ``append`` goes to Parquet; other
    modes keep the last batch's rows, which for ``complete`` are all."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, f"{name}-out"), shared_folder(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(out)


def _watermarked(rows: DataFrame, column: str, delay: str) -> DataFrame:
    return rows.withWatermark(column, delay) if rows.isStreaming else rows


def debounce_messages(messages: DataFrame, delay: str = "10 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Messages of a session within ``delay`` of the one before as one message, joined by line ends in time
    order. A group is given out when the watermark has passed its end."""
    rows = _watermarked(messages, "created_at", watermark)
    own = rows.groupBy("session_id", F.session_window("created_at", delay).alias("w")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "seq", "content"))).alias("parts")
    )
    return own.select("session_id", F.col("w.start").alias("first_at"), "n", F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content"))


def debounce_replies(messages: DataFrame, spans: DataFrame, delay: str = "10 seconds", watermark: str = "10 minutes", longest: str = "1 day", most_images: int = 3) -> DataFrame:
    """(session_id, first_at, n, content, images): ``debounce_messages`` where the assistant answers, with the first
    ``most_images`` images of a group; a message that comes while someone else does stands alone, as it is.

    ``spans``: (session_id, status, from_at, to_at), which don't overlap in a session; a longer one is renewed after
    ``longest``, so that a stream's join can end its state. Messages outside of all spans count as the assistant's ('ai').
    ``messages``: (session_id, seq, content, images, created_at); null images are none."""
    rows = _watermarked(messages, "created_at", watermark)
    known = _watermarked(spans.select(F.col("session_id").alias("of_session"), "status", "from_at", "to_at"), "from_at", watermark)
    inside = (F.col("session_id") == F.col("of_session")) & (F.col("created_at") >= F.col("from_at")) & (F.col("created_at") < F.col("to_at"))
    rows = rows.join(known, inside & (F.col("created_at") <= F.col("from_at") + F.expr(f"INTERVAL {longest}")), "left")
    alone = F.when(F.col("status") != "ai", F.col("seq")).alias("alone")
    part = F.struct("created_at", "seq", "content", F.coalesce("images", F.array().cast("array<string>")).alias("images"))
    own = rows.groupBy("session_id", alone, F.session_window("created_at", delay).alias("w")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    images = F.slice(F.flatten(F.transform("parts", lambda p: p["images"])), 1, most_images)
    return own.select("session_id", F.col("w.start").alias("first_at"), F.size("parts").alias("n"), F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content"), images.alias("images"))


def usage_windows(usage: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Tokens and calls per tenant, kind and tumbling window (UTC days by default)."""
    rows = _watermarked(usage, "created_at", watermark)
    own = rows.groupBy(F.window("created_at", window).alias("w"), "tenant_id", "kind").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("calls"))
    return own.select(F.col("w.start").alias("start"), "tenant_id", "kind", "tokens", "calls")


def quota_alerts(windows: DataFrame, tenants: DataFrame) -> DataFrame:
    """Windows of ``usage_windows`` (summed over kinds) that pass the tenant's quota."""
    day = windows.groupBy("start", "tenant_id").agg(F.sum("tokens").alias("tokens")).join(tenants.select("tenant_id", "daily_token_quota"), "tenant_id")
    return day.filter(F.col("tokens") > F.col("daily_token_quota"))


def rate_windows(usage: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", watermark: str = "5 minutes") -> DataFrame:
    """Offered requests per tenant in sliding windows."""
    rows = _watermarked(usage, "created_at", watermark)
    own = rows.groupBy(F.window("created_at", window, slide).alias("w"), "tenant_id").agg(F.count("*").alias("requests"))
    return own.select(F.col("w.start").alias("start"), "tenant_id", "requests")


def timing_windows(stages: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Latency percentiles per stage and window: values that occur, exact however many there are. A window's state is its
    distinct values with their counts; ``operators.sketches`` is the form of fixed size."""
    rows = _watermarked(stages, "created_at", watermark)
    percentiles = [F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY ms)").alias(f"p{round(100 * p)}_ms") for p in (0.5, 0.95)]
    own = rows.groupBy(F.window("created_at", window).alias("w"), "stage").agg(F.count("*").alias("calls"), *percentiles, F.max("ms").alias("max_ms"))
    return own.select(F.col("w.start").alias("start"), "stage", "calls", "p50_ms", "p95_ms", "max_ms")


def dedupe_stream(uploads: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Uploads without repeats of (tenant, base, name, size) inside the watermark; on a table, over all."""
    keys = ["tenant_id", "kb_id", "filename", "size_bytes"]
    if uploads.isStreaming:
        return uploads.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(keys)
    return uploads.dropDuplicates(keys)


def count_late(rows: DataFrame, path: str, state: str, watermark_s: int, then: Callable[[DataFrame, int], None] = lambda rows, number: None, column: str = "created_at") -> None:
    """Drain a stream: rows older than the watermark are counted before the others go to ``then``. Counters
    (n, late, newest) are written per batch under ``path``, from which a restarted job takes the watermark."""
    schema = "n long, late long, newest long"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = F.unix_timestamp(F.col(column).cast("timestamp"))
        before = None
        if number:
            before = spark.read.schema(f"{schema}, batch int").parquet(path).filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        late = at < F.lit(before - watermark_s) if before is not None else F.lit(False)
        counted = batch.agg(F.count("*").alias("n"), F.count_if(late).alias("late"), F.max(at).alias("newest"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")
        then(batch.filter(~late), number)

    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """(n, late) over all batches of ``count_late``."""
    return spark.read.parquet(path).agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
