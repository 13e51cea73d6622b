"""Conversation analytics over sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import round_even
from tidewell.sources.derived import LOW_CONFIDENCE, TEST_CHANNEL

OPEN = ("ai", "queued", "human")


def since(days: int, now: str, lowest: int = 1, highest: int = 90) -> Column:
    """The start of a period: ``days`` (clamped) before ``now``."""
    return F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{max(lowest, min(highest, days))}' DAY")


def since_days(rows: DataFrame, days: int, now: str) -> DataFrame:
    """Rows created in the period; rows without a time go."""
    return rows.filter(F.col("created_at") >= since(days, now))


def exclude_test_channel(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("channel") != TEST_CHANNEL)


def open_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("status").isin(*OPEN))


def list_sessions(sessions: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Live sessions, newest activity first; the limit is clamped to 1..200."""
    rows = exclude_test_channel(sessions)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("last_active_at"), "session_id").limit(max(1, min(200, limit)))


def handoff_queue(sessions: DataFrame) -> DataFrame:
    """Queued sessions with their place: who waits longest is first."""
    place = Window.partitionBy("tenant_id").orderBy("last_active_at", "session_id")
    rows = exclude_test_channel(sessions).filter(F.col("status") == "queued")
    return rows.withColumn("place", F.row_number().over(place))


def response_cycles(messages: DataFrame) -> DataFrame:
    """(tenant_id, session_id, wait_s) from the first visitor message after each reply to the next reply.
    The clock is re-armed by every reply, so a session can have many cycles; system rows don't count."""
    talk = messages.filter(F.col("role").isin("visitor", "ai", "agent"))
    reply = F.col("role") != "visitor"
    order = Window.partitionBy("session_id").orderBy("created_at", "seq")
    # Replies strictly before a row number its cycle; the reply that ends a cycle belongs to it.
    turns = talk.withColumn("cycle", F.sum(reply.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - reply.cast("int"))
    cycles = turns.groupBy("tenant_id", "session_id", "cycle").agg(F.min(F.when(~reply, F.col("created_at"))).alias("asked"), F.min(F.when(reply, F.col("created_at"))).alias("answered"))
    done = cycles.filter(F.col("asked").isNotNull() & F.col("answered").isNotNull())
    return done.select("tenant_id", "session_id", (F.unix_timestamp("answered") - F.unix_timestamp("asked")).alias("wait_s"))


def first_response_ms(messages: DataFrame) -> DataFrame:
    """Mean response time per tenant in whole milliseconds."""
    return response_cycles(messages).groupBy("tenant_id").agg(F.count("*").alias("cycles"), F.floor(F.avg("wait_s") * 1000).cast("long").alias("avg_first_ms"))


def status_counts(sessions: DataFrame) -> DataFrame:
    return exclude_test_channel(sessions).groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


def _no_hit() -> Column:
    return (F.col("role") == "system") & F.col("content").contains(LOW_CONFIDENCE)


def session_overview(sessions: DataFrame, messages: DataFrame, days: int, now: str, min_samples: int = 30) -> DataFrame:
    """One row per tenant with live sessions in the period; a tenant without any has no row, and a ratio
    without replies is null. One pass over messages, one shuffle by session that all facts share."""
    live = since_days(exclude_test_channel(sessions), days, now).select("tenant_id", "session_id", "status", "handoff_reason")
    facts = messages.groupBy("session_id").agg(F.count_if(_no_hit()).alias("no_hit"), F.count_if(F.col("role") == "ai").alias("replies"))
    waits = response_cycles(messages).groupBy("session_id").agg(F.count("*").alias("cycles"), F.sum("wait_s").alias("wait_s"))
    rows = live.join(facts, "session_id", "left").join(waits, "session_id", "left")
    handed = F.trim("handoff_reason") != ""
    out = rows.groupBy("tenant_id").agg(
        F.count("*").alias("sessions_total"),
        F.count_if(~handed).alias("sessions_ai_only"),
        F.count_if(handed).alias("sessions_handoff"),
        F.coalesce(F.sum("no_hit"), F.lit(0)).alias("no_hit_count"),
        F.coalesce(F.sum("replies"), F.lit(0)).alias("ai_replies"),
        F.coalesce(F.floor(F.sum("wait_s") * 1000 / F.sum("cycles")), F.lit(0)).cast("long").alias("avg_first_ms"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in ("ai", "queued", "human", "closed", "stopped")],
    )
    return out.select(
        "*",
        round_even(F.col("sessions_ai_only") * F.lit(100.0).cast("double") / F.col("sessions_total"), 1).alias("intercept_rate"),
        round_even(F.col("sessions_handoff") * F.lit(100.0).cast("double") / F.col("sessions_total"), 1).alias("handoff_rate"),
        round_even(F.col("no_hit_count") * F.lit(100.0).cast("double") / F.nullif("ai_replies", F.lit(0)), 1).alias("no_hit_ratio"),
        (F.col("sessions_total") >= min_samples).alias("sample_enough"),
        F.lit(None).cast("double").alias("resolve_rate"),
    )


def last_question_asof(messages: DataFrame) -> DataFrame:
    """Each low-confidence note with the last visitor message of its session up to it ('' if none): one
    sort by session and time instead of a query per note."""
    order = Window.partitionBy("session_id").orderBy("created_at", "seq")
    asked = F.last(F.when(F.col("role") == "visitor", F.col("content")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumn("question", F.coalesce(asked, F.lit("")))
    return rows.filter(_no_hit()).select("tenant_id", "session_id", "seq", "created_at", F.col("content").alias("note"), "question")


def unresolved_questions(messages: DataFrame, sessions: DataFrame, days: int, now: str, limit: int = 50) -> DataFrame:
    """Newest low-confidence notes of live sessions per tenant, with question and visitor. The top notes
    are found first; only their sessions' messages are sorted."""
    test = sessions.filter(F.col("channel") == TEST_CHANNEL).select("session_id")
    notes = since_days(messages.filter(_no_hit()), days, now).join(test, "session_id", "left_anti")
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), "session_id", "seq")
    top = notes.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= max(1, min(200, limit))).select("session_id", "seq", "place")
    asked = last_question_asof(messages.join(top.select("session_id").distinct(), "session_id", "left_semi"))
    out = asked.join(top, ["session_id", "seq"]).join(sessions.select("session_id", "visitor_id"), "session_id", "left")
    return out.select("tenant_id", "place", "session_id", "visitor_id", "question", "note", "created_at")


def recent_history(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each session, numbered oldest first."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("seq"))
    last = messages.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "seq"))).drop("back")


def cross_session_history(messages: DataFrame, sessions: DataFrame, n_sessions: int = 3, rows: int = 80, budget: int = 4000) -> DataFrame:
    """What a visitor and the service said in the visitor's latest other sessions, newest first until the
    character budget is spent. 'Other' leaves out the visitor's newest session."""
    latest = Window.partitionBy("tenant_id", "visitor_id").orderBy(F.desc("last_active_at"), F.desc("session_id"))
    chosen = exclude_test_channel(sessions).withColumn("back", F.row_number().over(latest)).filter(F.col("back").between(2, n_sessions + 1))
    said = messages.filter(F.col("role").isin("visitor", "ai")).withColumn("line", F.trim("content")).filter(F.col("line") != "")
    joined = said.join(chosen.select("session_id", "visitor_id"), "session_id")
    newest = Window.partitionBy("tenant_id", "visitor_id").orderBy(F.desc("created_at"), F.desc("session_id"), F.desc("seq"))
    top = joined.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= rows)
    spent = F.sum(F.length("line")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("spent", spent).filter(F.col("spent") <= budget).select("tenant_id", "visitor_id", "session_id", "seq", "role", "line", "spent")


def visitor_memory(notes: DataFrame, n: int = 10) -> DataFrame:
    """The newest n notes (tenant_id, visitor_id, note_id, content, updated_at) of each visitor, those without
    content dropped afterwards: an empty note uses up a place. Equal times go to the larger id."""
    newest = Window.partitionBy("tenant_id", "visitor_id").orderBy(F.desc("updated_at"), F.desc("note_id"))
    rows = notes.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
    return rows.filter(F.coalesce("content", F.lit("")) != "").select("tenant_id", "visitor_id", "note_id", "content", "back")


def current_session(sessions: DataFrame) -> DataFrame:
    """The newest open session per tenant, visitor and employee."""
    newest = Window.partitionBy("tenant_id", "visitor_id", "employee_id").orderBy(F.desc("last_active_at"), F.desc("session_id"))
    return open_sessions(sessions).withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")


def running_counts(messages: DataFrame) -> DataFrame:
    """AI replies and visitor messages so far at each visitor message, itself included."""
    upto = Window.partitionBy("session_id").orderBy("created_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = messages.select(
        "tenant_id", "session_id", "seq", "role",
        F.sum((F.col("role") == "ai").cast("long")).over(upto).alias("ai_replies"),
        F.sum((F.col("role") == "visitor").cast("long")).over(upto).alias("visitor_messages"),
    )
    return counted.filter(F.col("role") == "visitor").drop("role")


def stop_trigger(messages: DataFrame, groups: list[list[tuple[str, int]]], legacy_rounds: int = 0) -> DataFrame:
    """The first visitor message of each session at which a condition group holds; later ones are silent.

    Groups are alternatives, their conditions must all hold (count >= value); an unknown type never holds.
    Without groups ``legacy_rounds`` counts AI replies, 0 switches it off."""
    groups = groups or ([[("ai_rounds", legacy_rounds)]] if legacy_rounds > 0 else [])
    columns = {"ai_rounds": F.col("ai_replies"), "visitor_messages": F.col("visitor_messages")}
    fires = F.lit(False)
    for group in groups:
        if group:
            held = F.lit(True)
            for kind, value in group:
                held = held & (columns[kind] >= value if kind in columns else F.lit(False))
            fires = fires | held
    counted = running_counts(messages)
    first = counted.filter(fires).groupBy("session_id").agg(F.min("seq").alias("fired_at"))
    rows = counted.join(first, "session_id")
    return rows.groupBy("tenant_id", "session_id", "fired_at").agg(F.count_if(F.col("seq") > F.col("fired_at")).alias("silent_after"))


def no_answer_streak(messages: DataFrame, threshold: int = 2, enabled: bool = True) -> DataFrame:
    """At each low-confidence note, how many came in a row since the last real answer; the session is
    escalated where the streak reaches the threshold."""
    outcome = messages.filter(_no_hit() | (F.col("role") == "ai"))
    upto = Window.partitionBy("session_id").orderBy("created_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    islands = outcome.withColumn("island", F.sum((F.col("role") == "ai").cast("int")).over(upto)).filter(F.col("role") == "system")
    streak = F.row_number().over(Window.partitionBy("session_id", "island").orderBy("created_at", "seq"))
    out = islands.withColumn("streak", streak)
    return out.select("tenant_id", "session_id", "seq", "streak", (F.lit(enabled) & (F.col("streak") >= max(1, threshold))).alias("escalate"))


def sessions_with_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    return sessions.join(counts, "session_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def visitor_history(messages: DataFrame, sessions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` (1..200) messages of each visitor's latest session, oldest first; blank rows go
    after the limit."""
    latest = Window.partitionBy("tenant_id", "visitor_id").orderBy(F.desc("last_active_at"), F.desc("session_id"))
    last = sessions.withColumn("n", F.row_number().over(latest)).filter("n = 1").select("session_id", "visitor_id")
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("seq"))
    rows = messages.join(last, "session_id").withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= max(1, min(200, limit)))
    rows = rows.filter(F.trim("content") != "")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "seq"))).select("tenant_id", "visitor_id", "session_id", "place", "role", "content")
