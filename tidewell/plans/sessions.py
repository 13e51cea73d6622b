"""Queries of conversation analytics and their SQL."""

from __future__ import annotations

from tidewell.operators import sessions as S
from tidewell.sources.derived import frame, with_views

NOW, DAYS = "2024-01-08 00:00:00", 7
GROUPS = [[("ai_rounds", 2), ("visitor_messages", 3)], [("visitor_messages", 4)], [("unknown", 0)]]


def _(function, *views, **parameters):
    return lambda spark, sf_dir: function(*[frame(spark, sf_dir, v) for v in views], **parameters)


QUERIES = {
    "session_overview": _(S.session_overview, "sessions", "messages", days=DAYS, now=NOW),
    "first_response_ms": _(S.first_response_ms, "messages"),
    "status_counts": _(S.status_counts, "sessions"),
    "exclude_test_channel": _(S.exclude_test_channel, "sessions"),
    "open_sessions": _(S.open_sessions, "sessions"),
    "list_sessions": _(S.list_sessions, "sessions", status="closed", limit=500),
    "handoff_queue": _(S.handoff_queue, "sessions"),
    "last_question_asof": _(S.last_question_asof, "messages"),
    "unresolved_questions": _(S.unresolved_questions, "messages", "sessions", days=DAYS, now=NOW, limit=50),
    "recent_history": _(S.recent_history, "messages", n=3),
    "cross_session_history": _(S.cross_session_history, "messages", "sessions", budget=900),
    "visitor_memory": lambda s, d: S.visitor_memory(frame(s, d, "visitor_notes")),
    "current_session": _(S.current_session, "sessions"),
    "running_counts": _(S.running_counts, "messages"),
    "stop_trigger": _(S.stop_trigger, "messages", groups=GROUPS),
    "no_answer_streak": _(S.no_answer_streak, "messages", threshold=2),
    "sessions_with_counts": _(S.sessions_with_counts, "sessions", "messages"),
    "visitor_history": _(S.visitor_history, "messages", "sessions", limit=4),
}

_CYCLES = """
cycles AS (
  SELECT tenant_id, session_id, cycle, min(CASE WHEN role = 'visitor' THEN created_at END) AS asked, min(CASE WHEN role <> 'visitor' THEN created_at END) AS answered
  FROM (SELECT *, sum(CASE WHEN role <> 'visitor' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING)
               - CASE WHEN role <> 'visitor' THEN 1 ELSE 0 END AS cycle
        FROM messages WHERE role IN ('visitor', 'ai', 'agent'))
  GROUP BY tenant_id, session_id, cycle),
waits AS (SELECT tenant_id, session_id, CAST(epoch(answered) - epoch(asked) AS BIGINT) AS wait_s FROM cycles WHERE asked IS NOT NULL AND answered IS NOT NULL)"""

_ASOF = """
asked AS (
  SELECT tenant_id, session_id, seq, created_at, content AS note, role,
         coalesce(last_value(CASE WHEN role = 'visitor' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING), '') AS question
  FROM messages)"""

ORACLE_SQL = {
    "session_overview": with_views(f"""WITH {_CYCLES},
        live AS (SELECT * FROM sessions WHERE channel <> 'playground' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL '{DAYS}' DAY),
        facts AS (SELECT session_id, count(*) FILTER (WHERE role = 'system' AND content LIKE '%低置信%') AS no_hit, count(*) FILTER (WHERE role = 'ai') AS replies FROM messages GROUP BY 1),
        w AS (SELECT session_id, count(*) AS cycles, sum(wait_s) AS wait_s FROM waits GROUP BY 1)
        SELECT tenant_id, count(*) AS sessions_total, count(*) FILTER (WHERE trim(handoff_reason) = '') AS sessions_ai_only,
               count(*) FILTER (WHERE trim(handoff_reason) <> '') AS sessions_handoff, CAST(coalesce(sum(no_hit), 0) AS BIGINT) AS no_hit_count,
               CAST(coalesce(sum(replies), 0) AS BIGINT) AS ai_replies, CAST(coalesce(floor(sum(wait_s) * 1000.0 / sum(cycles)), 0) AS BIGINT) AS avg_first_ms,
               count(*) FILTER (WHERE status = 'ai') AS status_ai, count(*) FILTER (WHERE status = 'queued') AS status_queued,
               count(*) FILTER (WHERE status = 'human') AS status_human, count(*) FILTER (WHERE status = 'closed') AS status_closed,
               count(*) FILTER (WHERE status = 'stopped') AS status_stopped,
               CAST(printf('%.1f', CAST(count(*) FILTER (WHERE trim(handoff_reason) = '') * 100.0 AS DOUBLE) / count(*)) AS DOUBLE) AS intercept_rate,
               CAST(printf('%.1f', CAST(count(*) FILTER (WHERE trim(handoff_reason) <> '') * 100.0 AS DOUBLE) / count(*)) AS DOUBLE) AS handoff_rate,
               CAST(printf('%.1f', CAST(coalesce(sum(no_hit), 0) * 100.0 AS DOUBLE) / nullif(coalesce(sum(replies), 0), 0)) AS DOUBLE) AS no_hit_ratio,
               count(*) >= 30 AS sample_enough, CAST(NULL AS DOUBLE) AS resolve_rate
        FROM live LEFT JOIN facts USING (session_id) LEFT JOIN w USING (session_id) GROUP BY tenant_id""", "sessions"),
    "first_response_ms": with_views(f"WITH {_CYCLES} SELECT tenant_id, count(*) AS cycles, CAST(floor(avg(wait_s) * 1000) AS BIGINT) AS avg_first_ms FROM waits GROUP BY 1", "messages"),
    "status_counts": with_views("SELECT tenant_id, status, count(*) AS n FROM sessions WHERE channel <> 'playground' GROUP BY 1, 2", "sessions"),
    "exclude_test_channel": with_views("SELECT * FROM sessions WHERE channel <> 'playground'", "sessions"),
    "open_sessions": with_views("SELECT * FROM sessions WHERE status IN ('ai', 'queued', 'human')", "sessions"),
    "list_sessions": with_views("SELECT * FROM sessions WHERE channel <> 'playground' AND status = 'closed' ORDER BY last_active_at DESC, session_id LIMIT 200", "sessions"),
    "handoff_queue": with_views("SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY last_active_at, session_id) AS place FROM sessions WHERE channel <> 'playground' AND status = 'queued'", "sessions"),
    "last_question_asof": with_views(f"WITH {_ASOF} SELECT tenant_id, session_id, seq, created_at, note, question FROM asked WHERE role = 'system' AND note LIKE '%低置信%'", "messages"),
    "unresolved_questions": with_views(f"""WITH {_ASOF},
        notes AS (SELECT * FROM asked WHERE role = 'system' AND note LIKE '%低置信%' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL '{DAYS}' DAY
                  AND session_id NOT IN (SELECT session_id FROM sessions WHERE channel = 'playground')),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, session_id, seq) AS place FROM notes)
        SELECT p.tenant_id, place, session_id, visitor_id, question, note, p.created_at FROM placed p LEFT JOIN sessions USING (session_id) WHERE place <= 50""", "sessions"),
    "recent_history": with_views("""WITH last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, seq DESC) AS back FROM messages)
        SELECT * EXCLUDE (back), row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS place FROM last WHERE back <= 3""", "messages"),
    "cross_session_history": with_views("""WITH chosen AS (SELECT session_id, visitor_id, row_number() OVER (PARTITION BY tenant_id, visitor_id ORDER BY last_active_at DESC, session_id DESC) AS b
                   FROM sessions WHERE channel <> 'playground'),
        said AS (SELECT m.tenant_id, visitor_id, session_id, seq, role, trim(content) AS line, m.created_at,
                        row_number() OVER (PARTITION BY m.tenant_id, visitor_id ORDER BY m.created_at DESC, session_id DESC, seq DESC) AS back
                 FROM messages m JOIN chosen USING (session_id) WHERE b BETWEEN 2 AND 4 AND role IN ('visitor', 'ai') AND trim(content) <> ''),
        spent AS (SELECT *, CAST(sum(length(line)) OVER (PARTITION BY tenant_id, visitor_id ORDER BY created_at DESC, session_id DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM said WHERE back <= 80)
        SELECT tenant_id, visitor_id, session_id, seq, role, line, spent FROM spent WHERE spent <= 900""", "sessions"),
    "visitor_memory": with_views("""SELECT tenant_id, visitor_id, note_id, content, CAST(back AS INT) AS back FROM (
        SELECT *, row_number() OVER (PARTITION BY tenant_id, visitor_id ORDER BY updated_at DESC, note_id DESC) AS back FROM visitor_notes) WHERE back <= 10 AND content <> ''""", "visitor_notes"),
    "current_session": with_views("""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, visitor_id, employee_id ORDER BY last_active_at DESC, session_id DESC) AS n
        FROM sessions WHERE status IN ('ai', 'queued', 'human')) WHERE n = 1""", "sessions"),
    "running_counts": with_views("""SELECT tenant_id, session_id, seq, CAST(ai AS BIGINT) AS ai_replies, CAST(vi AS BIGINT) AS visitor_messages FROM (
        SELECT *, sum(CASE WHEN role = 'ai' THEN 1 ELSE 0 END) OVER w AS ai, sum(CASE WHEN role = 'visitor' THEN 1 ELSE 0 END) OVER w AS vi
        FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING)) WHERE role = 'visitor'""", "messages"),
    "stop_trigger": with_views("""WITH c AS (SELECT * FROM (SELECT *, sum(CASE WHEN role = 'ai' THEN 1 ELSE 0 END) OVER w AS ai, sum(CASE WHEN role = 'visitor' THEN 1 ELSE 0 END) OVER w AS vi
        FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING)) WHERE role = 'visitor'),
        f AS (SELECT session_id, min(seq) AS fired_at FROM c WHERE (ai >= 2 AND vi >= 3) OR vi >= 4 GROUP BY 1)
        SELECT tenant_id, session_id, fired_at, count(*) FILTER (WHERE seq > fired_at) AS silent_after FROM c JOIN f USING (session_id) GROUP BY 1, 2, 3""", "messages"),
    "no_answer_streak": with_views("""WITH o AS (SELECT *, sum(CASE WHEN role = 'ai' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING) AS island
        FROM messages WHERE role = 'ai' OR (role = 'system' AND content LIKE '%低置信%')),
        s AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, island ORDER BY created_at, seq) AS INT) AS streak FROM o WHERE role = 'system')
        SELECT tenant_id, session_id, seq, streak, streak >= 2 AS escalate FROM s""", "messages"),
    "sessions_with_counts": with_views("SELECT s.*, coalesce(n_messages, 0) AS n_messages FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n_messages FROM messages GROUP BY 1) USING (session_id)", "sessions"),
    "visitor_history": with_views("""WITH l AS (SELECT session_id, visitor_id, row_number() OVER (PARTITION BY tenant_id, visitor_id ORDER BY last_active_at DESC, session_id DESC) AS n FROM sessions),
        r AS (SELECT m.*, visitor_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, seq DESC) AS back FROM messages m JOIN l USING (session_id) WHERE n = 1)
        SELECT tenant_id, visitor_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS place, role, content FROM r WHERE back <= 4 AND trim(content) <> ''""", "sessions"),
}
