"""Queries of rules whose inputs are derived from the tables by expressions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import documents as D
from tidewell.operators import retrieval as R
from tidewell.operators import scope as S
from tidewell.operators import sheets as H
from tidewell.plans.documents import CELLS, CUTS, cells, stripped, whole
from tidewell.plans.retrieval import _hit_sql
from tidewell.sources.derived import frame, with_views


def _docs(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", F.expr("concat('d', doc_id, '.txt') AS filename"), "text", "source")


def _flag(spark, sf):
    rows = _docs(spark, sf).withColumn("text", F.expr("concat(text, CASE doc_id % 4 WHEN 0 THEN concat(' 订单编号：', 100000 + doc_id) WHEN 1 THEN concat(' SKU ID: ', doc_id % 1000) WHEN 2 THEN concat(' 运单号 : 99', 1000000 + doc_id) ELSE '' END)"))
    return rows.select("doc_id", X.is_identifier_row("text").alias("noise"))


def _strip(spark, sf):
    rows = _docs(spark, sf).withColumn("text", F.expr("concat(CASE doc_id % 3 WHEN 0 THEN concat('【', source, '】《', filename, '》 ') WHEN 1 THEN concat('【', source, '】') ELSE '' END, text)"))
    return rows.select("doc_id", X.strip_meta("text").alias("bare"))


def _status(spark, sf):
    warnings = F.expr("CASE doc_id % 4 WHEN 0 THEN array('已剥离 3 个跨页重复的页眉/页脚行') WHEN 1 THEN array('检测到首列存在合并单元格，已向下填充', concat('lost ', text)) WHEN 2 THEN array() ELSE array('分隔符不明，已按逗号处理') END")
    return _docs(spark, sf).select("doc_id", X.document_status(warnings).alias("status"))


def _kv(spark, sf):
    body = F.expr("concat(text, '\nintro line. ', doc_id, '\n', 'Model M', doc_id, '\nPower ', doc_id % 50, 'W\nWeight ', doc_id % 9, 'kg\n- Voltage 220V\nColor blue\nCapacity ', doc_id % 7, 'L\n', CASE WHEN doc_id % 2 = 0 THEN 'Lone a: sentence with marks' ELSE 'Range 5m' END)")
    return _docs(spark, sf).withColumn("text", body)


def _service(spark, sf):
    body = F.expr("concat(text, '\nfirst\n', CASE WHEN doc_id % 2 = 0 THEN concat('请联系售后服务中心： 400-', 100 + doc_id % 900, '-8888，谢谢\n') ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '官网： www.example.com.\n' ELSE 'www.other.example\n' END, CASE WHEN doc_id % 5 = 0 THEN '请用微信扫描，联系在线客服。\n' ELSE '微信\n' END, '400-999-9999')")
    return D.service_summary(_docs(spark, sf).withColumn("text", body))


def _first_use(spark, sf):
    body = F.expr("concat(text, '；请注意首次使用前需要充电', doc_id, '小时以上。', CASE WHEN doc_id % 2 = 0 THEN '首次使用时请先撕掉 外部保护膜。' ELSE '短句。' END, '这里没有提示词但是足够长的句子。如家中地毯有流苏边，请先将其折好')")
    return D.first_use_summary(_docs(spark, sf).withColumn("text", body))


def _bullets(spark, sf):
    body = F.expr("concat(text, '\n• 请勿将基站放在阳光直射的地方', doc_id, '。\n• 长期存放前请先充满电，并且\n每 3 个月补充电一次。\n', CASE WHEN doc_id % 2 = 0 THEN '靠墙放置在平坦的地面，周围不要\n放置物品。' ELSE '\n' END)")
    return D.bullet_summary(_docs(spark, sf).withColumn("text", body)).select("doc_id", "text")


def _record(spark, sf):
    block = F.expr("concat('【', p_brand, '】', p_name, '：size: ', p_size, '；type: ', p_type, '；', p_partkey, '；kind：', p_brand, '；size:  ', p_size + 1)")
    r = X.parse_record_block(block)
    return frame(spark, sf, "part").select("p_partkey", r["sheet"].alias("sheet"), r["title"].alias("title"), F.array_join(F.transform(r["fields"], lambda f: F.concat(f["k"], F.lit("="), f["v"])), "|").alias("fields"))


def _turns(spark, sf):
    raw = F.expr("CASE WHEN item_id % 2 = 0 THEN concat('第一轮：', text, '｜第二轮：', item_id, ' b') ELSE concat(' ', text, ' only ') END")
    return frame(spark, sf, "benchmark").select("item_id", F.array_join(X.split_turns(raw), "+").alias("turns"))


def _verdict(spark, sf):
    raw = F.expr("""CASE WHEN doc_id % 3 = 0 THEN concat(text, ' {"verdict": "pass", "diff": "', doc_id, '", "reason": "ok"} thanks') WHEN doc_id % 3 = 1 THEN concat(text, '{"verdict": "partial"}') ELSE text END""")
    v = X.parse_verdict(raw)
    rows = frame(spark, sf, "labels").join(frame(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", v["verdict"].alias("verdict"), v["diff"].alias("diff"), v["reason"].alias("reason"))


def _images(spark, sf):
    rows = frame(spark, sf, "documents").select(F.expr("doc_id % 90 AS doc_id"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("content"), F.expr("CAST(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 200 END AS INT) AS width"), F.lit(100).alias("height"))
    return D.dedupe_images(rows, least_bytes=900).select("doc_id", "seq", F.octet_length("content").cast("long").alias("bytes"))


def _descriptions(spark, sf):
    mark = "【图】文档此处有一张图片，图中内容无法提取"
    rows = _docs(spark, sf).select("doc_id", F.concat(F.col("text"), F.lit(mark), F.lit("b"), F.when(F.col("doc_id") % 2 == 0, mark).otherwise("")).alias("text"))
    shown = _docs(spark, sf).filter("doc_id % 3 <> 0").select("doc_id", F.posexplode(F.expr("array(concat('x', text), 'y')")).alias("seq", "description")).withColumn("page", F.lit(2))
    return D.apply_descriptions(rows, shown)


def _publish(spark, sf):
    people = frame(spark, sf, "customer").select(F.col("c_custkey").alias("employee_id"), F.expr("CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Hi {{channel}}' ELSE 'Hi {{nobody}}' END AS persona"))
    kb = people.filter("employee_id % 3 = 0").select("employee_id", F.expr("concat('src', employee_id % 25) AS kb_id"))
    doc = people.filter("employee_id % 5 = 0").select("employee_id", F.expr("employee_id % 300 AS doc_id"))
    out = S.publish_checks(people, kb, doc, frame(spark, sf, "kb_documents"), X.unknown_variables("persona"))
    return out.select("employee_id", F.array_join("blocked", "; ").alias("blocked"), F.array_join("confirm", "; ").alias("confirm"))


def _message_images(spark, sf):
    """Messages that name images by number; an image is the text of a document, its owner by the number."""
    ids = F.expr("transform(array(session_id + 12 * (seq + 1), session_id + seq + 1, session_id + 12 * (seq + 1), session_id + 12 * (seq + 3), 9), i -> concat('i', i))")
    messages = frame(spark, sf, "messages").select(F.expr("session_id * 100 + seq AS message_id"), "session_id", "tenant_id", F.expr("session_id % 12 AS visitor_id"), "seq", "content", ids.alias("image_ids"))
    messages = messages.withColumn("meta", F.expr("""concat('{"images": [{"id": "i', session_id + seq + 1, '"}, {"id": "i', session_id + 12 * (seq + 1), '"}]}')"""))
    images = frame(spark, sf, "documents").select(F.expr("concat('i', doc_id) AS image_id"), F.expr("doc_id % 4 AS tenant_id"), F.expr("doc_id % 12 AS visitor_id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS ocr_text"))
    return messages, images


def _image_text(spark, sf):
    messages, images = _message_images(spark, sf)
    return S.messages_with_image_text(messages.drop("seq"), images).withColumn("content", F.md5("content"))


def _claims(spark, sf):
    messages, images = _message_images(spark, sf)
    return S.claim_images(messages.drop("seq"), images)


def _service_hits(spark, sf):
    chunks = frame(spark, sf, "chunks").withColumn("text", F.expr("CASE WHEN chunk_id % 25 = 7 THEN concat('【售后服务】', text) ELSE text END"))
    queries = frame(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("concat(text, CASE WHEN item_id % 2 = 0 THEN ' 怎么维修' ELSE ' 价格' END) AS text"))
    where = queries.select("query_id", F.expr("query_id % 4 AS tenant_id")).join(frame(spark, sf, "chunks").select("tenant_id", "kb_id").distinct(), "tenant_id")
    hits = queries.filter("query_id % 6 = 0").select("query_id", F.col("query_id").alias("chunk_id"), F.lit("k").alias("kb_id"), F.lit(0).cast("long").alias("doc_id"), F.lit(0.5).alias("score"), F.concat(F.lit("【售后服务】"), "text").alias("text"), F.lit(1).alias("place"))
    return R.service_supplement(hits, queries, where, chunks).select("query_id", "chunk_id", "score", "place")


def _overview_hits(spark, sf):
    """Questions and nearest chunks are those of the vector join; every third question has a hit."""
    from tidewell.plans.retrieval import _hits

    chunks = frame(spark, sf, "chunks").withColumn("text", F.expr("CASE chunk_id % 10 WHEN 3 THEN concat('【文档概览】', text) WHEN 7 THEN concat('【条目速览】', text) ELSE text END"))
    where = frame(spark, sf, "query_vectors").select("query_id", "tenant_id").join(chunks.select("tenant_id", "kb_id").distinct(), "tenant_id")
    near = _hits(spark, sf)
    hits = near.filter("query_id % 150 = 0").select("query_id", "score")
    return R.overview_fallback_hits(hits, where, chunks, near.select("query_id", "chunk_id", "score"))


def _headers(spark, sf):
    return H.header_template_columns(cells(spark, sf), 0, 2)


def _title(spark, sf):
    top = frame(spark, sf, "part").select(F.expr("CAST(floor(p_partkey / 50) AS BIGINT) AS sheet_id")).distinct().select("sheet_id", F.explode(F.expr("array(-3, -2)")).alias("row_no"), F.lit(0).alias("col_no"), F.expr("'t'").alias("value"))
    top = top.withColumn("value", F.expr("concat('title', row_no, ' ', sheet_id)"))
    return H.leading_title(cells(spark, sf).unionByName(top))


def _reindex(spark, sf):
    rows = frame(spark, sf, "documents").select(F.expr("doc_id % 100 AS doc_id"), F.col("doc_id").alias("seq"), "text")
    return whole(D.reindex_document(rows))


def _alias(spark, sf):
    fields = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' CTN weight') WHEN 1 THEN concat(p_name, ' Unit price') WHEN 2 THEN '重量' WHEN 3 THEN p_name ELSE concat('Max distance ', p_type) END")
    return frame(spark, sf, "part").select("p_partkey", X.field_alias(fields).alias("alias"))


QUERIES = {
    "flag_identifier_rows": _flag,
    "strip_meta": _strip,
    "document_status": _status,
    "kv_dense_segments": lambda s, d: D.kv_dense_segments(D.lines_of(_kv(s, d))).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "key", "value"),
    "kv_param_summary": lambda s, d: D.kv_param_summary(_kv(s, d)).select("doc_id", "text"),
    "service_summary": _service,
    "first_use_summary": _first_use,
    "bullet_summary": _bullets,
    "parse_record_block": _record,
    "split_turns": _turns,
    "parse_verdict": _verdict,
    "dedupe_images": _images,
    "apply_descriptions": _descriptions,
    "publish_checks": _publish,
    "messages_with_image_text": _image_text,
    "claim_images": _claims,
    "service_supplement": _service_hits,
    "overview_fallback_hits": _overview_hits,
    "header_template_columns": _headers,
    "leading_title": _title,
    "reindex_document": _reindex,
    "field_alias": _alias,
}

_KEY = "regexp_matches(k, '^[一-鿿A-Za-z0-9（）()\\-－/／·～~．.]+$') AND length(k) BETWEEN 2 AND 14 AND NOT regexp_matches(k, '^[0-9]+$') AND (regexp_matches(k, '[一-鿿]') OR length(k) >= 3)"
_PAIRS = f"""docs AS (SELECT doc_id, concat('d', doc_id, '.txt') AS filename, concat(text, chr(10), 'intro line. ', doc_id, chr(10), 'Model M', doc_id, chr(10), 'Power ', doc_id % 50, 'W', chr(10), 'Weight ', doc_id % 9, 'kg', chr(10), '- Voltage 220V', chr(10), 'Color blue', chr(10),
          'Capacity ', doc_id % 7, 'L', chr(10), CASE WHEN doc_id % 2 = 0 THEN 'Lone a: sentence with marks' ELSE 'Range 5m' END) AS text FROM documents),
        lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
        b AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[•·\\-–—*]\\s*', '') AS bare FROM lines),
        s AS (SELECT *, regexp_extract(bare, '^(\\S+)\\s+(.+)$', 1) AS k, trim(regexp_extract(bare, '^(\\S+)\\s+(.+)$', 2)) AS v FROM b),
        g AS (SELECT doc_id, line_no, bare, CASE WHEN ok THEN k END AS key, CASE WHEN ok THEN v END AS value FROM (SELECT *, {_KEY} AND v <> '' AND length(v) <= 40 AND NOT regexp_matches(v, '[。！？；，、：:]') AS ok FROM s)),
        n AS (SELECT *, lead(key) OVER w AS next_key, lead(value) OVER w AS next_value, bare AS k FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        br AS (SELECT *, key IS NULL AND next_key IS NOT NULL AND {_KEY} AND length(concat(bare, next_key)) <= 16 AND regexp_matches(concat(bare, next_key), '^[一-鿿A-Za-z0-9（）()\\-－/／·～~．.]+$') AS broken FROM n),
        t AS (SELECT *, coalesce(lag(broken) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE) AS taken FROM br),
        p AS (SELECT doc_id, line_no, CASE WHEN broken THEN concat(bare, next_key) ELSE key END AS key, CASE WHEN broken THEN next_value ELSE value END AS value FROM t WHERE NOT taken AND (broken OR key IS NOT NULL)),
        d AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY line_no RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) - 1 AS near FROM p) WHERE near >= 2),
        e AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 3 THEN 1 ELSE 0 END AS opens FROM d),
        seg AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM e)"""

ORACLE_SQL = {
    "reindex_document": f"""WITH RECURSIVE b AS (SELECT * FROM (SELECT doc_id % 100 AS doc_id, doc_id AS i, {stripped("text")} AS text FROM documents) WHERE text <> ''), {CUTS},
        p AS (SELECT doc_id, i, 0 AS nth, text AS piece FROM b WHERE length(text) <= 600 UNION ALL SELECT * FROM cut WHERE piece <> '')
        SELECT doc_id, count(*) AS n, md5(string_agg(piece, '|' ORDER BY i, nth)) AS text FROM p GROUP BY 1""",
    "flag_identifier_rows": f"SELECT doc_id, doc_id % 4 IN (0, 2) OR regexp_matches(text, '{X.ID_ROW}') AS noise FROM documents",
    "strip_meta": """WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+', '') AS bare, concat(CASE doc_id % 3 WHEN 0 THEN concat('【', source, '】《d', doc_id, '.txt》 ') WHEN 1 THEN concat('【', source, '】') ELSE '' END, text) AS whole FROM documents)
        SELECT doc_id, CASE WHEN bare = '' THEN whole ELSE bare END AS bare FROM d""",
    "document_status": "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'partial' ELSE 'success' END AS status FROM documents",
    "kv_dense_segments": f"WITH {_PAIRS} SELECT doc_id, CAST(line_no AS INT) AS line_no, key, value FROM seg",
    "kv_param_summary": f"""WITH RECURSIVE {_PAIRS}, f AS (SELECT *, min(segment) OVER (PARTITION BY doc_id, key) AS first FROM seg),
        o AS (SELECT doc_id, segment, concat('【参数对照】《', filename, '》') AS head, concat(key, '：', value, '；') AS item, row_number() OVER (PARTITION BY doc_id, segment ORDER BY line_no) AS n, count(*) OVER (PARTITION BY doc_id, segment) AS m FROM f JOIN docs USING (doc_id) WHERE segment = first),
        r AS (SELECT doc_id, segment, head, item, n, 1 AS piece, 600 - length(head) - length(item) AS room FROM o WHERE n = 1 AND m >= 5
          UNION ALL SELECT o.doc_id, o.segment, o.head, o.item, o.n, piece + CASE WHEN room < length(o.item) THEN 1 ELSE 0 END, CASE WHEN room < length(o.item) THEN 600 - length(o.head) ELSE room END - length(o.item)
          FROM r JOIN o ON o.doc_id = r.doc_id AND o.segment = r.segment AND o.n = r.n + 1)
        SELECT doc_id, concat(head, rtrim(string_agg(item, '' ORDER BY n), '；')) AS text FROM r GROUP BY doc_id, segment, head, piece""",
    "service_summary": """WITH l AS (SELECT doc_id, string_split(concat(text, chr(10), 'first', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('请联系售后服务中心： 400-', 100 + doc_id % 900, '-8888，谢谢', chr(10)) ELSE '' END,
          CASE WHEN doc_id % 3 = 0 THEN '官网： www.example.com.' ELSE 'www.other.example' END, chr(10), CASE WHEN doc_id % 5 = 0 THEN '请用微信扫描，联系在线客服。' ELSE '微信' END, chr(10), '400-999-9999'), chr(10)) AS l FROM documents),
        s AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM l),
        o AS (SELECT doc_id, arg_min(concat('售后服务中心：', regexp_extract(line, '4[0-9]{2}-[0-9]{3}-[0-9]{4}')), n) FILTER (WHERE contains(line, '售后服务中心')) AS phone,
          arg_min(concat('官网：', rtrim(regexp_extract(line, 'www[.][A-Za-z0-9.-]+'), '.')), n) FILTER (WHERE contains(line, '官网')) AS site, arg_min(line, n) FILTER (WHERE contains(line, '微信') AND contains(line, '在线客服')) AS chat FROM s GROUP BY 1)
        SELECT doc_id, concat('【售后服务】《d', doc_id, '.txt》', concat_ws('；', phone, site, chat)) AS text FROM o WHERE coalesce(phone, site, chat) IS NOT NULL""",
    "first_use_summary": """WITH s AS (SELECT doc_id, regexp_extract_all(concat(text, '；请注意首次使用前需要充电', doc_id, '小时以上。', CASE WHEN doc_id % 2 = 0 THEN '首次使用时请先撕掉 外部保护膜。' ELSE '短句。' END, '这里没有提示词但是足够长的句子。如家中地毯有流苏边，请先将其折好'), '[^。；]+[。；]?') AS l FROM documents),
        p AS (SELECT doc_id, regexp_replace(unnest(l), '\\s+', '', 'g') AS s, generate_subscripts(l, 1) AS n FROM s),
        h AS (SELECT doc_id, n, CASE WHEN regexp_matches(s, '使用前|首次使用|收纳好|整理出') THEN regexp_extract(s, '(使用前|首次使用|收纳好|整理出).*$') ELSE s END AS s FROM p
              WHERE length(s) BETWEEN 12 AND 120 AND regexp_matches(s, '首次使用|使用前|防护栏|流苏边|收纳好|整理出[^。]*清扫空间')),
        u AS (SELECT doc_id, s, min(n) AS n FROM h WHERE length(s) >= 12 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM u)
        SELECT doc_id, concat('【首次使用要点】《d', doc_id, '.txt》', string_agg(s, '；' ORDER BY k)) AS text FROM k WHERE k <= 8 GROUP BY 1 HAVING count(*) >= 2""",
    "parse_record_block": "SELECT p_partkey, p_brand AS sheet, p_name AS title, concat('size=', p_size + 1, '|type=', p_type, '；', p_partkey, '|kind=', p_brand) AS fields FROM part",
    "split_turns": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN concat(trim(text, ' ' || chr(10)), '+', item_id, ' b') ELSE concat(trim(text, ' ' || chr(10)), ' only') END AS turns FROM benchmark",
    "parse_verdict": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'partial' ELSE 'fail' END AS verdict, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN 'unreadable' END AS diff,
        CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 2 THEN substr(text, 1, 200) END AS reason FROM labels JOIN documents USING (doc_id)""",
    "dedupe_images": """WITH i AS (SELECT doc_id % 90 AS d, doc_id AS seq, text, strlen(text) AS bytes FROM documents WHERE strlen(text) >= 900 AND (doc_id % 7 = 0 OR least(doc_id % 200, 100) >= 64)),
        k AS (SELECT *, row_number() OVER (PARTITION BY d, text ORDER BY seq) AS n FROM i)
        SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY seq) AS INT) AS seq, bytes FROM k WHERE n = 1""",
    "apply_descriptions": """WITH m AS (SELECT '【图】文档此处有一张图片，图中内容无法提取' AS mark)
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, mark, 'b', CASE WHEN doc_id % 2 = 0 THEN mark ELSE '' END) WHEN doc_id % 2 = 0 THEN concat(text, '【图】x', text, 'b【图】y')
        ELSE concat(text, mark, 'b', chr(10), '【图】(page 2, no. 0) x', text, chr(10), '【图】(page 2, no. 1) y') END AS text FROM documents, m""",
    "publish_checks": with_views("""WITH e AS (SELECT c_custkey AS e FROM customer), live AS (SELECT DISTINCT kb_id FROM kb_documents WHERE enabled)
        SELECT e AS employee_id, CASE e % 4 WHEN 0 THEN 'persona is blank' WHEN 1 THEN '' ELSE 'unknown variables: nobody' END AS blocked,
        CASE WHEN e % 5 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM kb_documents k WHERE k.enabled AND k.doc_id = e % 300) THEN '' ELSE 'no bound document is enabled' END
             WHEN e % 3 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM live WHERE kb_id = concat('src', e % 25)) THEN '' ELSE 'no bound document is enabled' END ELSE 'nothing is bound' END AS confirm FROM e""", "kb_documents"),
    "messages_with_image_text": with_views("""WITH i AS (SELECT doc_id AS i, doc_id % 4 AS tenant_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS t FROM documents),
        m AS (SELECT session_id * 100 + seq AS message_id, tenant_id, content, session_id + seq + 1 AS one, session_id + 12 * (seq + 1) AS two FROM messages)
        SELECT message_id, md5(concat_ws(chr(10), content, nullif(coalesce(a.t, ''), ''), nullif(coalesce(b.t, ''), ''))) AS content FROM m
        LEFT JOIN i a ON a.i = one AND a.tenant_id = m.tenant_id LEFT JOIN i b ON b.i = two AND b.tenant_id = m.tenant_id""", "messages"),
    "claim_images": with_views("""WITH i AS (SELECT doc_id AS i, doc_id % 4 AS tenant_id, doc_id % 12 AS visitor_id FROM documents),
        m AS (SELECT session_id * 100 + seq AS message_id, session_id, tenant_id, session_id % 12 AS visitor_id, seq FROM messages),
        w AS (SELECT *, 0 AS pos, session_id + 12 * (seq + 1) AS i FROM m UNION ALL SELECT *, 1, session_id + seq + 1 FROM m UNION ALL SELECT *, 2, session_id + 12 * (seq + 3) FROM m)
        SELECT message_id, pos, concat('i', i) AS image_id, session_id FROM w JOIN i USING (i, tenant_id, visitor_id)""", "messages"),
    "service_supplement": with_views("""WITH q AS (SELECT item_id AS query_id FROM benchmark), b AS (SELECT chunk_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY doc_id, seq, chunk_id) AS n FROM chunks WHERE enabled AND chunk_id % 25 = 7)
        SELECT query_id, query_id AS chunk_id, CAST(0.5 AS DOUBLE) AS score, 1 AS place FROM q WHERE query_id % 6 = 0
        UNION ALL SELECT query_id, chunk_id, 0, 1 FROM q JOIN b ON tenant_id = query_id % 4 AND n = 1 WHERE query_id % 2 = 0 AND query_id % 6 <> 0""", "chunks"),
    "overview_fallback_hits": _hit_sql("""q AS (SELECT query_id, tenant_id FROM query_vectors WHERE query_id NOT IN (SELECT query_id FROM hits WHERE query_id % 150 = 0 AND score > 0)),
        o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, seq, chunk_id) AS p FROM q JOIN chunks USING (tenant_id) WHERE enabled AND chunk_id % 10 IN (3, 7)),
        n AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS p FROM hits JOIN q USING (query_id)),
        u AS (SELECT query_id, chunk_id, CAST(0 AS DOUBLE) AS score, 0 AS part, p FROM o WHERE p <= 4 UNION ALL SELECT query_id, chunk_id, score, 1, p FROM n WHERE p <= 3),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part, p) AS k FROM u)
        SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, p) AS INT) AS place FROM k WHERE k = 1""", "chunks"),
    "header_template_columns": f"""WITH cells AS ({CELLS}), r AS (SELECT sheet_id, col_no, row_no, trim(value) AS v, min(row_no) OVER (PARTITION BY sheet_id, col_no, trim(value)) AS f FROM cells WHERE row_no <= 2 AND trim(value) <> '')
        SELECT sheet_id, col_no, string_agg(v, ' > ' ORDER BY row_no) AS name FROM r WHERE row_no = f GROUP BY 1, 2""",
    "leading_title": "SELECT DISTINCT p_partkey // 50 AS sheet_id, concat('title-3 ', p_partkey // 50, ' title-2 ', p_partkey // 50) AS title FROM part",
    "field_alias": f"""WITH f AS (SELECT p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' CTN weight') WHEN 1 THEN concat(p_name, ' Unit price') WHEN 2 THEN '重量' WHEN 3 THEN p_name ELSE concat('Max distance ', p_type) END) AS f FROM part)
        SELECT p_partkey, CASE {' '.join(f"WHEN contains(f, '{w}') THEN '{a}'" for w, a in X.FIELD_ALIASES)} WHEN f = '重量' THEN f ELSE '' END AS alias FROM f""",
}
