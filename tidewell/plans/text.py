"""Queries of text functions and triage rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import intent as I
from tidewell.functions import text as X
from tidewell.operators.lifecycle import refuse_stats
from tidewell.operators.sessions import stop_trigger
from tidewell.plans.sessions import GROUPS
from tidewell.sources.derived import frame, with_views


def _docs(columns):
    """``columns`` is called when the query runs: expressions need a session."""
    return lambda spark, sf: frame(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in columns().items()])


_RULES = "array(named_struct('days', array(0, 1, 2, 3, 4), 'start', '22:00', 'end', '06:30'), named_struct('days', array(5, 6), 'start', '12:15', 'end', '12:15'), named_struct('days', array(0), 'start', 'x', 'end', '24:00'))"


def _stop_window(spark, sf):
    rows = frame(spark, sf, "events").withColumn("zone", F.expr("CASE WHEN user_id % 3 = 0 THEN 'Asia/Shanghai' WHEN user_id % 3 = 1 THEN 'nowhere' ELSE 'UTC' END"))
    return rows.select("event_id", I.in_stop_window(F.col("ts"), F.col("zone"), F.expr(_RULES)).alias("stopped"))


def _route(spark, sf):
    messages, sessions = frame(spark, sf, "messages"), frame(spark, sf, "sessions")
    fired = stop_trigger(messages, GROUPS).select("session_id", "fired_at")
    rows = messages.filter("role = 'visitor'").join(sessions.select("session_id", "status", "channel"), "session_id").join(fired, "session_id", "left")
    e = F.expr
    path = I.turn_route(
        I.detect_intent("content"), e("channel <> 'playground'"), F.col("status"), e("hour(created_at) = 3"), e("coalesce(seq >= fired_at, false)"),
        e("length(content) % 3 = 0"), e("length(content) % 2 = 0"), e("seq"), F.lit(3), e("CASE session_id % 3 WHEN 0 THEN 'clarify' WHEN 1 THEN 'fallback' ELSE 'handoff' END"),
        e("length(content) % 15 = 0"), e("length(content) % 7 = 0"), e("length(content) % 11 = 0"), e("length(content) % 13 <> 0"),
    )
    return rows.select("session_id", "seq", path.alias("path"))


def _persona(spark, sf):
    template = F.concat(F.lit("Hi {{ visitor.id }}, {{tenant.name}}: "), F.col("text"), F.lit(" {{other.x}} {{ visitor.id}}"))
    rows = frame(spark, sf, "documents").withColumn("template", template)
    values = {"visitor.id": F.concat(F.lit("v$"), F.col("doc_id")), "tenant.name": F.repeat(F.col("source"), 60)}
    return rows.select("doc_id", X.render_persona("template", values).alias("shown"), F.array_join(X.extract_variables("template"), ",").alias("names"), F.array_join(X.unknown_variables("template"), ",").alias("unknown"))


def _refuse(spark, sf):
    rows = frame(spark, sf, "messages").withColumn("content", F.expr("CASE WHEN seq % 5 = 1 THEN concat(content, ' 没有相关资料') ELSE content END"))
    return refuse_stats(rows, X.is_refusal("content"))


def _intents(spark, sf):
    rows = frame(spark, sf, "conversations").select("conv_id", "turn", F.expr("CASE WHEN turn % 4 = 1 THEN concat(text, ' I want a refund, this is terrible') WHEN turn % 4 = 2 THEN concat('You IDIOT. ', text) WHEN turn % 4 = 3 THEN concat('talk to a human: ', text) ELSE text END").alias("text"))
    return rows.select("conv_id", "turn", I.detect_intent("text").alias("i")).select("conv_id", "turn", *[F.col(f"i.{k}").alias(k) for k in ("handoff", "reason", "abuse", "ad", "meaningless", "language")])


QUERIES = {
    "normalize_text": _docs(lambda: dict(out=F.md5(X.normalize_text(F.concat(F.lit("  "), F.regexp_replace("text", "\\. ", ".   \r\n")))))),
    "text_helpers": _docs(lambda: dict(ws=F.md5(X.normalize_ws("text")), short=X.truncate("text", 30), slug=F.md5(X.slugify("text")), masked=X.mask_secret("text"), chars=X.count_chars("text"))),
    "strip_control_chars": _docs(lambda: dict(out=F.md5(X.strip_control_chars(F.concat(F.lit("a\x01b\x7f\t"), "text"))))),
    "detect_language": lambda s, d: frame(s, d, "conversations").select("conv_id", "turn", X.detect_language("text").alias("language")),
    "split_sub_intents": lambda s, d: frame(s, d, "conversations").select("conv_id", "turn", F.array_join(X.split_sub_intents("text"), "|").alias("parts")),
    "is_meaningless": lambda s, d: frame(s, d, "conversations").select("conv_id", "turn", I.is_meaningless(F.col("text")).alias("flag")),
    "detect_intent": _intents,
    "confidence": lambda s, d: frame(s, d, "events").select("event_id", X.confidence(F.col("value") / 500 - 0.02).alias("confidence")),
    "embed_tokens": _docs(lambda: dict(n=F.size(X.embed_tokens("text")).cast("long"), tokens=F.md5(F.array_join(X.embed_tokens("text"), " ")))),
    "estimate_tokens": _docs(lambda: dict(tokens=X.estimate_tokens("text"))),
    "persona": _persona,
    "refuse_stats": _refuse,
    "in_stop_window": _stop_window,
    "turn_route": _route,
    "split_reply": _docs(lambda: dict(parts=F.array_join(X.split_reply("text", 3), "|"))),
    "cell_type": lambda s, d: frame(s, d, "part").select("p_partkey", X.cell_type("p_name").alias("name"), X.cell_type("p_size").alias("size"), X.cell_type(F.concat(F.col("p_size"), F.lit("KG"))).alias("weight"), X.cell_type(F.concat(F.lit("$1,"), F.col("p_partkey"))).alias("price")),
}

_TURN = "CASE WHEN turn % 4 = 1 THEN concat(text, ' I want a refund, this is terrible') WHEN turn % 4 = 2 THEN concat('You IDIOT. ', text) WHEN turn % 4 = 3 THEN concat('talk to a human: ', text) ELSE text END"


def _any(column, phrases):
    return "(" + " OR ".join(f"contains(lower({column}), lower('{p}'))" for p in phrases) + ")"


def _first(column, phrases):
    return "CASE " + " ".join(f"WHEN contains(lower({column}), lower('{p}')) THEN '{p}'" for p in phrases) + " END"


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

ORACLE_SQL = {
    "normalize_text": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(concat('  ', regexp_replace(text, '\\. ', '.   ' || chr(13) || chr(10), 'g')), '\\r\\n|\\r', chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) AS out FROM documents",
    "text_helpers": """SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ' || chr(10))) AS ws, CASE WHEN length(text) <= 30 THEN text ELSE concat(substr(text, 1, 29), '…') END AS short,
        md5(CASE WHEN trim(regexp_replace(lower(text), '[^a-zA-Z0-9一-鿿]+', '-', 'g'), '-') = '' THEN substr(md5(text), 1, 8) ELSE trim(regexp_replace(lower(text), '[^a-zA-Z0-9一-鿿]+', '-', 'g'), '-') END) AS slug,
        CASE WHEN length(text) <= 8 THEN repeat('*', length(text)) ELSE concat(substr(text, 1, 4), '********', right(text, 4)) END AS masked, CAST(length(text) AS INT) AS chars FROM documents""",
    "strip_control_chars": "SELECT doc_id, md5(regexp_replace(concat('a', chr(1), 'b', chr(127), chr(9), text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS out FROM documents",
    "detect_language": """SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[a-zA-Z]')) = 0 THEN '' ELSE 'en' END AS language FROM conversations""",
    "split_sub_intents": """WITH p AS (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS whole, list_filter(list_transform(regexp_split_to_array(text, '[!?;\\n]+'), lambda x: trim(x)), lambda x: length(x) >= 2) AS parts FROM conversations),
        d AS (SELECT *, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS u FROM p)
        SELECT conv_id, turn, CASE WHEN len(u) = 0 THEN whole ELSE array_to_string(u[1:4], '|') END AS parts FROM d""",
    "is_meaningless": "WITH t AS (SELECT conv_id, turn, lower(trim(text, ' ' || chr(10))) AS t FROM conversations) SELECT conv_id, turn, t IN ('hi', 'hello', 'test', 'hey', 'hey?', 'hi?', 'yo', 'ok', '11', '1', '.', '?') OR length(t) <= 1 AS flag FROM t",
    "detect_intent": f"""WITH t AS (SELECT conv_id, turn, {_TURN} AS text FROM conversations),
        r AS (SELECT *, CASE WHEN {_any('text', I.HANDOFF)} THEN 'asked for a person' WHEN {_any('text', I.RISK)} THEN concat('risk: ', {_first('text', I.RISK)})
            WHEN {_any('text', I.REFUND)} AND {_any('text', I.NEGATIVE)} THEN concat('refund with anger: ', {_first('text', I.REFUND)}) ELSE '' END AS reason FROM t)
        SELECT conv_id, turn, reason <> '' AS handoff, reason, {_any('text', I.ABUSE)} AS abuse, {_any('text', I.ADS)} AS ad,
        lower(trim(text)) IN ('hi', 'hello', 'test', 'hey', 'yo', 'ok') OR length(trim(text)) <= 1 AS meaningless, CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE '' END AS language FROM r""",
    "confidence": """SELECT event_id, CAST(CASE WHEN value / 500 - 0.02 <= 0 THEN 0 WHEN value / 500 - 0.02 >= 0.95 THEN 99 ELSE least(99, greatest(0, round_even((value / 500 - 0.02) * 100, 0))) END AS INT) AS confidence FROM events""",
    "embed_tokens": f"SELECT doc_id, len({_TOKENS}) AS n, md5(array_to_string({_TOKENS}, ' ')) AS tokens FROM documents",
    "estimate_tokens": "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS INT) AS tokens FROM documents",
    "persona": """SELECT doc_id, concat('Hi v$', doc_id, ', ', CASE WHEN length(repeat(source, 60)) <= 200 THEN repeat(source, 60) ELSE concat(substr(repeat(source, 60), 1, 199), '…') END, ': ', text, ' {{other.x}} v$', doc_id) AS shown,
        'other.x,tenant.name,visitor.id' AS names, 'other.x' AS unknown FROM documents""",
    "refuse_stats": with_views("SELECT tenant_id, count(*) AS replies, round(avg(CASE WHEN seq % 5 = 1 OR content = '' THEN 1.0 ELSE 0.0 END), 6) AS refuse_rate FROM messages WHERE role = 'ai' GROUP BY 1", "messages"),
    "in_stop_window": """WITH l AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL '8' HOUR ELSE ts END AS t FROM events),
        m AS (SELECT event_id, extract(hour FROM t) * 60 + extract(minute FROM t) AS m, isodow(t) - 1 AS d FROM l)
        SELECT event_id, (d <= 4 AND (m >= 1320 OR m <= 390)) OR (d >= 5 AND m = 735) AS stopped FROM m""",
    "turn_route": with_views(f"""WITH c AS (SELECT * FROM (SELECT *, sum(CASE WHEN role = 'ai' THEN 1 ELSE 0 END) OVER w AS ai, sum(CASE WHEN role = 'visitor' THEN 1 ELSE 0 END) OVER w AS vi
        FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING)) WHERE role = 'visitor'),
        f AS (SELECT session_id, min(seq) AS fired_at FROM c WHERE (ai >= 2 AND vi >= 3) OR vi >= 4 GROUP BY 1),
        x AS (SELECT c.session_id, c.seq, content, status, channel, c.created_at, fired_at, length(content) AS n, c.session_id % 3 AS p FROM c JOIN sessions s USING (session_id) LEFT JOIN f USING (session_id))
        SELECT session_id, seq, CASE WHEN channel = 'playground' THEN 'channel_off' WHEN status = 'stopped' THEN 'session_stopped' WHEN extract(hour FROM created_at) = 3 THEN 'stop_window'
          WHEN coalesce(seq >= fired_at, FALSE) THEN 'stop_condition'
          WHEN {_any('content', I.HANDOFF)} OR {_any('content', I.RISK)} OR ({_any('content', I.REFUND)} AND {_any('content', I.NEGATIVE)}) THEN 'handoff_forced'
          WHEN {_any('content', I.ABUSE)} THEN 'abuse' WHEN {_any('content', I.ADS)} THEN 'ad' WHEN lower(trim(content)) IN ('hi', 'hello', 'test', 'hey', 'yo', 'ok') OR length(trim(content)) <= 1 THEN 'meaningless'
          WHEN n % 3 = 0 AND n % 15 <> 0 AND n % 2 <> 0 AND n % 7 = 0 THEN 'ctx_fallback' WHEN n % 3 = 0 AND n % 15 <> 0 AND n % 2 <> 0 AND n % 11 = 0 THEN 'overview_fallback'
          WHEN n % 3 = 0 AND n % 15 <> 0 AND p = 0 AND seq < 3 THEN 'lowconf_clarify' WHEN n % 3 = 0 AND n % 15 <> 0 AND p = 1 AND n % 2 = 0 THEN 'lowconf_fallback'
          WHEN n % 3 = 0 AND n % 15 <> 0 THEN 'handoff_lowconf' WHEN n % 13 = 0 THEN 'llm_unavailable' ELSE 'normal' END AS path FROM x""", "messages", "sessions"),
    "split_reply": """WITH s AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents),
        l AS (SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '[^。！？!?；;\n]+[。！？!?；;]?'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM s),
        n AS (SELECT *, len(l) AS n, greatest(2, least(CASE WHEN len(l) <= 6 THEN least(3, len(l) - 1) ELSE 3 END, len(l))) AS g FROM l)
        SELECT doc_id, CASE WHEN length(t) <= 80 OR n < 2 THEN t ELSE array_to_string(list_transform(range(g), lambda k: trim(array_to_string(l[k * (n // g) + least(k, n % g) + 1 : k * (n // g) + least(k, n % g) + n // g + CASE WHEN k < n % g THEN 1 ELSE 0 END], ''))), '|') END AS parts FROM n""",
    "cell_type": """SELECT p_partkey, CASE WHEN length(trim(p_name)) <= 24 AND length(p_name) - length(replace(p_name, ' ', '')) <= 3 THEN 'code' ELSE 'text' END AS name, 'num' AS size, 'measure' AS weight, 'num' AS price FROM part""",
}
