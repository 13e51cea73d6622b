"""Views that give the stand-in tables the shape of the service's tables.

Each view is one SELECT that Spark and DuckDB read alike, over tables or earlier views; ``frame`` runs it
on Spark, ``with_views`` puts the same text in front of an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The marker that a system note carries when nothing relevant was found (fixed value).
LOW_CONFIDENCE = "低置信"
TEST_CHANNEL = "playground"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("conversations",), f"""
        SELECT conv_id % 4 AS tenant_id, conv_id AS session_id, turn AS seq,
               CASE WHEN role = 'user' THEN 'visitor' WHEN role = 'system' THEN 'system'
                    WHEN (conv_id + turn) % 7 = 0 THEN 'system' ELSE 'ai' END AS role,
               CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN '{LOW_CONFIDENCE}: nothing relevant' ELSE text END AS content,
               TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 3600 + turn * 60 + (conv_id * 7 + turn * 13) % 50) * INTERVAL '1' SECOND AS created_at
        FROM conversations"""),
    "sessions": (("messages",), f"""
        SELECT session_id, session_id % 4 AS tenant_id, session_id % 12 AS visitor_id, session_id % 8 AS employee_id,
               CASE WHEN session_id % 10 = 9 THEN '{TEST_CHANNEL}' ELSE 'web' END AS channel,
               CASE session_id % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'queued' WHEN 2 THEN 'human' WHEN 3 THEN 'closed' ELSE 'stopped' END AS status,
               CASE WHEN session_id % 5 = 1 THEN 'asked for a person' ELSE '' END AS handoff_reason,
               min(created_at) AS created_at, max(created_at) AS last_active_at
        FROM messages GROUP BY session_id"""),
    "status_spans": (("messages",), """
        SELECT session_id, 'ai' AS status, created_at - INTERVAL '1' MINUTE AS from_at, created_at + INTERVAL '3' MINUTE AS to_at
        FROM messages WHERE seq = 0 AND session_id % 5 <> 4
        UNION ALL
        SELECT session_id, CASE session_id % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'queued' ELSE 'human' END AS status, created_at + INTERVAL '3' MINUTE AS from_at, created_at + INTERVAL '12' HOUR AS to_at
        FROM messages WHERE seq = 0 AND session_id % 5 <> 4"""),
    "usage_records": (("events",), """
        SELECT event_id AS usage_id, user_id % 4 AS tenant_id, user_id AS visitor_id,
               CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 8 END AS employee_id, event_type AS kind,
               CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens,
               CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) AS total_tokens, ts AS created_at
        FROM events"""),
    "audit_logs": (("events",), """
        SELECT event_id AS audit_id, user_id % 4 AS tenant_id, event_type AS action,
               CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 'deny' ELSE 'allow' END AS result, ts AS created_at
        FROM events"""),
    "playground_runs": (("events",), """
        SELECT event_id AS run_id, user_id % 4 AS tenant_id, user_id % 8 AS employee_id, value / 100 AS score,
               CAST(floor(value * 37) AS BIGINT) % 9000 AS latency_ms, CAST(floor(value) AS BIGINT) AS tokens,
               event_type <> 'error' AS ok, ts AS created_at
        FROM events"""),
    "tenants": (("nation",), """
        SELECT n_nationkey AS tenant_id, n_name AS name, CASE WHEN n_nationkey % 6 = 5 THEN 'suspended' ELSE 'active' END AS status,
               CASE WHEN n_nationkey = 3 THEN 0 ELSE 40000 + 5000 * n_nationkey END AS daily_token_quota, 20 + n_nationkey AS rpm_limit,
               'UTC' AS timezone
        FROM nation"""),
    "kb_documents": (("documents",), """
        SELECT doc_id, source AS kb_id, CAST(substr(source, 4) AS INT) % 4 AS tenant_id, concat('d', doc_id, '.txt') AS filename,
               n_chars AS size_bytes, doc_id % 6 <> 0 AS enabled, text,
               TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at
        FROM documents"""),
    "uploads": (("kb_documents",), """
        SELECT doc_id, kb_id, tenant_id, filename, size_bytes, created_at FROM kb_documents
        UNION ALL
        SELECT doc_id + 1000000, kb_id, tenant_id, filename, size_bytes, created_at + INTERVAL '30' DAY FROM kb_documents WHERE doc_id % 5 = 0"""),
    "chunk_vectors": (("embeddings",), """
        SELECT vec_id AS chunk_id, label AS kb_id, label % 4 AS tenant_id, vec_id % 37 AS doc_id, vec_id % 9 <> 0 AS enabled, embedding
        FROM embeddings"""),
    "query_vectors": (("embeddings",), "SELECT vec_id AS query_id, label AS gold_kb, label % 4 AS tenant_id, embedding FROM embeddings WHERE vec_id % 50 = 0"),
    "visitor_notes": (("events",), """
        SELECT event_id AS note_id, user_id % 4 AS tenant_id, user_id AS visitor_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS content, ts AS updated_at
        FROM events"""),
    "chunks": (("documents",), """
        SELECT doc_id AS chunk_id, doc_id % 97 AS doc_id, source AS kb_id, CAST(substr(source, 4) AS INT) % 4 AS tenant_id,
               0 AS seq, text, doc_id % 6 <> 0 AS enabled
        FROM documents"""),
}


def _order(names: tuple[str, ...], found: list[str]) -> list[str]:
    for name in names:
        if name in VIEWS and name not in found:
            _order(VIEWS[name][0], found)
            found.append(name)
    return found


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the folder where no view has the name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text = VIEWS[name]
    return spark.sql(_named(text, needs), **{n: frame(spark, sf_dir, n) for n in needs})


def _named(text: str, names: tuple[str, ...]) -> str:
    """The text with its tables as arguments of ``spark.sql``; format braces don't occur in views."""
    import re

    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(names)})\b", r"\1 {\2}", text)


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views (and those they need) as common table expressions."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _order(names, [])]
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{', '.join(parts)}, {body[len(start):]}"
    return f"WITH {', '.join(parts)} {body}"
