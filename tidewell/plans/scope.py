"""Queries of scope, bindings, documents lists, purges and checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import lifecycle as L
from tidewell.operators import scope as S
from tidewell.sources.derived import frame, with_views


def _split(parts, key, names=("own", "rejected")):
    a, b = parts
    return a.select(*key, F.lit(names[0]).alias("part")).union(b.select(*key, F.lit(names[1])))


def _tenant_scope(spark, sf):
    return S.tenant_scope(frame(spark, sf, "kb_documents"), 2, kb_id="src2").select("doc_id", "tenant_id", "kb_id", "size_bytes")


def _assert_same(spark, sf):
    return _split(S.assert_same_tenant(frame(spark, sf, "kb_documents"), 1), ["doc_id"])


def _toggle(spark, sf):
    toggles = frame(spark, sf, "kb_documents").filter("doc_id % 10 = 3").select(F.col("doc_id"), F.expr("doc_id % 20 = 3 AS enabled"))
    return S.set_document_enabled(frame(spark, sf, "chunks"), toggles).select("chunk_id", "doc_id", "enabled")


def _bases(spark, sf):
    docs = frame(spark, sf, "kb_documents")
    return docs.groupBy("kb_id").agg(F.sum("size_bytes").alias("total_bytes")).withColumn("kb_name", F.concat(F.lit("base "), "kb_id"))


def _verify(spark, sf):
    hits = frame(spark, sf, "chunk_vectors").select("chunk_id", F.expr("CASE WHEN chunk_id % 13 = 0 THEN (tenant_id + 1) % 4 ELSE tenant_id END AS tenant_id")).union(spark.sql("SELECT CAST(id + 5000000 AS BIGINT), 1 FROM range(7)"))
    return _split(S.verify_hits(hits, frame(spark, sf, "chunk_vectors")), ["tenant_id", "chunk_id"], ("kept", "rejected"))


def _resolve(spark, sf):
    people = frame(spark, sf, "conversations").select(F.expr("conv_id AS employee_id")).distinct()
    kbs = people.filter("employee_id % 3 = 0").select("employee_id", F.expr("concat('kb', employee_id % 5) AS kb_id"))
    docs = people.filter("employee_id % 2 = 0").select("employee_id", F.expr("employee_id + 7 AS doc_id"))
    override = people.filter("employee_id % 10 = 0").select("employee_id", F.expr("CASE WHEN employee_id % 20 = 0 THEN NULL ELSE concat('o', employee_id) END AS scope_id"))
    return S.resolve_scope(people, kbs, docs, override)


def _validate(spark, sf):
    own = frame(spark, sf, "kb_documents").select("tenant_id", F.col("doc_id").alias("target_id"))
    asked = own.select(F.expr("CASE WHEN target_id % 9 = 0 THEN (tenant_id + 1) % 4 ELSE tenant_id END AS tenant_id"), "target_id")
    return _split(S.validate_bindings(asked, own), ["tenant_id", "target_id"], ("valid", "rejected"))


def _diff(spark, sf):
    orders = frame(spark, sf, "orders")
    pairs = orders.select(F.col("o_custkey").alias("employee_id"), F.expr("o_orderkey % 40 AS target_id"), "o_orderkey")
    return S.binding_diff(pairs.filter("o_orderkey % 3 <> 0"), pairs.filter("o_orderkey % 3 <> 1"), spark.range(35).select(F.col("id").alias("target_id")))


def _keys(spark, sf):
    people = frame(spark, sf, "customer")
    keys = people.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("tenant_id"), F.expr("c_custkey % 100 AS employee_id"), F.lit("web").alias("channel"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'revoked' ELSE 'active' END AS status"))
    employees = people.filter("c_custkey < 100").select(F.expr("c_custkey % 100 AS employee_id"), F.expr("c_custkey % 25 AS tenant_id"))
    requests = frame(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.expr("o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS key"))
    return S.resolve_channel_key(requests, keys, frame(spark, sf, "tenants"), employees)


def _purge(spark, sf):
    docs = frame(spark, sf, "kb_documents").select("doc_id", "kb_id", "tenant_id", "size_bytes")
    gone = docs.filter("doc_id % 4 = 1").select("doc_id")
    a, b, c = L.purge_document(docs, frame(spark, sf, "chunks"), _bases(spark, sf), gone)
    one = a.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("size_bytes").alias("bytes"))
    two = b.select(F.lit("chunk"), F.col("chunk_id").cast("string"), F.lit(0).cast("bigint"))
    return one.union(two).union(c.select(F.lit("base"), "kb_id", "total_bytes"))


def _purge_tenant(spark, sf):
    tables = {n: frame(spark, sf, n) for n in ("kb_documents", "chunks", "usage_records", "audit_logs")}
    out = None
    for name, rows in L.purge_tenant(tables, 2).items():
        counted = rows.groupBy("tenant_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.col("tenant_id").cast("long").alias("tenant_id"), "n")
        out = counted if out is None else out.union(counted)
    return out


def _purge_kb(spark, sf):
    docs = frame(spark, sf, "kb_documents")
    bound = spark.sql("SELECT 'src3' AS kb_id")
    out = L.purge_kb(_bases(spark, sf), docs, frame(spark, sf, "chunks"), bound, spark.sql("SELECT concat('src', id) AS kb_id FROM range(1, 5)"))
    parts = [out[n].groupBy("kb_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "kb_id", "n") for n in ("bases", "documents", "chunks", "refused")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _orphans(spark, sf):
    parents = frame(spark, sf, "orders").filter("o_orderkey % 17 <> 0")
    return L.orphan_rows(frame(spark, sf, "lineitem"), parents, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def _reconcile(spark, sf):
    left = frame(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    right = left.filter("o_orderkey % 19 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 23 = 0 THEN '?' ELSE o_orderstatus END"))
    right = right.union(left.filter("o_orderkey % 29 = 0").withColumn("o_orderkey", F.expr("o_orderkey + 100000000")))
    return L.reconcile_tables(left, right, ["o_orderkey"])


def _versions(spark, sf):
    saves = frame(spark, sf, "orders").select(F.col("o_custkey").alias("employee_id"), F.col("o_orderkey").alias("save_id"), F.col("o_orderdate").alias("saved_at"))
    return L.employee_versions(saves, keep=10).select("employee_id", "save_id", "version_no")


def _evolve(spark, sf):
    schema = {"o_orderkey": "bigint", "o_orderstatus": "string", "channel": "string", "priority_no": "int"}
    return L.evolve_schema(frame(spark, sf, "orders"), schema, {"channel": "web", "priority_no": 3})


def _convert(kind, expression):
    def run(spark, sf):
        rows = frame(spark, sf, "orders").select("o_orderkey", F.expr(f"{expression} AS raw"))
        return L.convert_column(rows, "raw", kind, "orders").select("o_orderkey", "value", "error")

    return run


_RAW_BOOLEAN = "CASE o_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN 'f' WHEN 2 THEN 'Yes' WHEN 3 THEN '2' WHEN 4 THEN NULL WHEN 5 THEN 'TRUE' ELSE 'no' END"
_RAW_INTEGER = "CASE o_orderkey % 6 WHEN 0 THEN '42' WHEN 1 THEN ' 42 ' WHEN 2 THEN '3.0' WHEN 3 THEN '3.5' WHEN 4 THEN '' ELSE CAST(o_custkey AS STRING) END"


def _json_problems(spark, sf):
    rows = frame(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 3) WHEN event_id % 50 = 1 THEN '' ELSE props END AS props"))
    return L.json_text_problems(rows, "props").select("event_id")


def _eval(spark, sf):
    rows = frame(spark, sf, "labels").select(F.expr("concat('c', doc_id % 7) AS category"), F.expr("concat('d', doc_id % 3) AS difficulty"), F.expr("CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 1 THEN 'partial' ELSE 'fail' END AS verdict"))
    return L.eval_summary(rows)


def _snapshot(spark, sf):
    rows = frame(spark, sf, "orders").select(F.col("o_orderkey").alias("employee_id"), F.col("o_orderstatus").alias("name"), F.expr("CAST(o_custkey % 9 AS INT) AS reply_delay_min"), F.expr("CAST(o_custkey % 9 + 2 AS INT) AS reply_delay_max"))
    shots = L.snapshot_json(rows.filter("employee_id % 2 = 0"), ["name", "reply_delay_min"])
    blank = rows.withColumns({"name": F.lit("none"), "reply_delay_min": F.lit(-1)})
    return L.apply_snapshot(blank, shots, "name string, reply_delay_min int")


def _caps(spark, sf):
    return S.admit_with_caps(frame(spark, sf, "uploads"), max_docs=40, max_kb_bytes=60_000).select("doc_id", "reason")


QUERIES = {
    "tenant_scope": _tenant_scope,
    "assert_same_tenant": _assert_same,
    "set_document_enabled": _toggle,
    "admit_uploads": lambda s, d: S.admit_uploads(frame(s, d, "uploads"), max_bytes=9000).select("doc_id", "reason"),
    "admit_with_caps": _caps,
    "first_document_wins": lambda s, d: S.first_document_wins(frame(s, d, "uploads")).select("doc_id", "kb_id", "filename", "size_bytes"),
    "chunks_with_filename": lambda s, d: S.chunks_with_filename(frame(s, d, "chunks").drop("text"), frame(s, d, "kb_documents").filter("doc_id % 5 <> 0")),
    "verify_hits": _verify,
    "resolve_scope": _resolve,
    "validate_bindings": _validate,
    "binding_diff": _diff,
    "resolve_channel_key": _keys,
    "kb_inventory": lambda s, d: S.kb_inventory(_bases(s, d).select("kb_id"), frame(s, d, "kb_documents").filter("kb_id <> 'src1'"), frame(s, d, "chunks").filter("kb_id <> 'src2'")),
    "tenant_documents": lambda s, d: S.tenant_documents(frame(s, d, "kb_documents").drop("text"), _bases(s, d).filter("kb_id <> 'src4'")),
    "ordered_lists": lambda s, d: S.ordered_lists(frame(s, d, "kb_documents")),
    "purge_document": _purge,
    "purge_tenant": _purge_tenant,
    "purge_kb": _purge_kb,
    "orphan_rows": _orphans,
    "constraint_violations": lambda s, d: L.constraint_violations(frame(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "reconcile_tables": _reconcile,
    "employee_versions": _versions,
    "evolve_schema": _evolve,
    "convert_boolean": _convert("boolean", _RAW_BOOLEAN),
    "convert_integer": _convert("integer", _RAW_INTEGER),
    "json_text_problems": _json_problems,
    "eval_summary": _eval,
    "snapshot_round_trip": _snapshot,
}

_BASES = "bases AS (SELECT kb_id, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, concat('base ', kb_id) AS kb_name FROM kb_documents GROUP BY kb_id)"

ORACLE_SQL = {
    "tenant_scope": with_views("SELECT doc_id, tenant_id, kb_id, size_bytes FROM kb_documents WHERE tenant_id = 2 AND kb_id = 'src2'", "kb_documents"),
    "assert_same_tenant": with_views("SELECT doc_id, CASE WHEN tenant_id = 1 THEN 'own' ELSE 'rejected' END AS part FROM kb_documents", "kb_documents"),
    "set_document_enabled": with_views("SELECT chunk_id, doc_id, CASE WHEN doc_id % 10 = 3 THEN doc_id % 20 = 3 ELSE enabled END AS enabled FROM chunks", "chunks"),
    "admit_uploads": with_views("""SELECT doc_id, CASE WHEN size_bytes > 9000 THEN 'size' WHEN size_bytes <= 0 THEN 'empty'
        WHEN row_number() OVER (PARTITION BY tenant_id, kb_id, filename, size_bytes ORDER BY created_at, doc_id) > 1 THEN 'duplicate' END AS reason FROM uploads""", "uploads"),
    "admit_with_caps": with_views("""WITH RECURSIVE a AS (SELECT doc_id, tenant_id, kb_id, size_bytes, created_at, CASE WHEN size_bytes > 20971520 THEN 'size' WHEN size_bytes <= 0 THEN 'empty'
          WHEN row_number() OVER (PARTITION BY tenant_id, kb_id, filename, size_bytes, size_bytes > 20971520 OR size_bytes <= 0 ORDER BY created_at, doc_id) > 1 THEN 'duplicate' END AS reason FROM uploads),
        x AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, kb_id ORDER BY created_at, doc_id) AS n FROM a),
        r AS (SELECT CAST(NULL AS BIGINT) AS doc_id, tenant_id, kb_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS docs, CAST(0 AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT tenant_id, kb_id FROM x)
          UNION ALL SELECT doc_id, tenant_id, kb_id, n, docs + CASE WHEN why IS NULL THEN 1 ELSE 0 END, bytes + CASE WHEN why IS NULL THEN size_bytes ELSE 0 END, why
          FROM (SELECT x.doc_id, x.tenant_id, x.kb_id, x.n, r.docs, r.bytes, x.size_bytes, coalesce(x.reason, CASE WHEN r.docs >= 40 THEN 'documents' WHEN r.bytes + x.size_bytes > 60000 THEN 'bytes' END) AS why
                FROM r JOIN x ON x.tenant_id = r.tenant_id AND x.kb_id = r.kb_id AND x.n = r.n + 1))
        SELECT doc_id, reason FROM r WHERE n > 0""", "uploads"),
    "first_document_wins": with_views("SELECT doc_id, kb_id, filename, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY kb_id, filename, size_bytes ORDER BY created_at, doc_id) AS n FROM uploads) WHERE n = 1", "uploads"),
    "chunks_with_filename": with_views("SELECT c.* EXCLUDE (text), coalesce(filename, '') AS filename FROM chunks c LEFT JOIN (SELECT doc_id, filename FROM kb_documents WHERE doc_id % 5 <> 0) USING (doc_id)", "chunks", "kb_documents"),
    "verify_hits": with_views("""WITH hits AS (SELECT chunk_id, CASE WHEN chunk_id % 13 = 0 THEN (tenant_id + 1) % 4 ELSE tenant_id END AS tenant_id FROM chunk_vectors
        UNION ALL SELECT range + 5000000, 1 FROM range(7))
        SELECT h.tenant_id, h.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'rejected' ELSE 'kept' END AS part FROM hits h
        LEFT JOIN chunk_vectors c ON c.chunk_id = h.chunk_id AND c.tenant_id = h.tenant_id AND c.enabled""", "chunk_vectors"),
    "resolve_scope": """WITH p AS (SELECT DISTINCT conv_id AS e FROM conversations)
        SELECT e AS employee_id, 'kb' AS scope_kind, concat('o', e) AS scope_id FROM p WHERE e % 10 = 0 AND e % 20 <> 0
        UNION ALL SELECT e, 'kb', concat('kb', e % 5) FROM p WHERE e % 10 <> 0 AND e % 3 = 0
        UNION ALL SELECT e, 'doc', CAST(e + 7 AS VARCHAR) FROM p WHERE e % 10 <> 0 AND e % 3 <> 0 AND e % 2 = 0""",
    "validate_bindings": with_views("""SELECT CASE WHEN doc_id % 9 = 0 THEN (tenant_id + 1) % 4 ELSE tenant_id END AS tenant_id, doc_id AS target_id,
        CASE WHEN doc_id % 9 = 0 THEN 'rejected' ELSE 'valid' END AS part FROM kb_documents""", "kb_documents"),
    "binding_diff": """WITH p AS (SELECT o_custkey AS employee_id, o_orderkey % 40 AS target_id, o_orderkey FROM orders),
        n AS (SELECT DISTINCT employee_id, target_id FROM p WHERE o_orderkey % 3 <> 0), r AS (SELECT DISTINCT employee_id, target_id FROM p WHERE o_orderkey % 3 <> 1),
        w AS (SELECT * FROM r WHERE target_id < 35)
        SELECT *, 'add' AS action FROM (SELECT * FROM w EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'keep' FROM (SELECT * FROM w INTERSECT SELECT * FROM n)
        UNION ALL SELECT *, 'remove' FROM (SELECT * FROM n EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'reject' FROM r WHERE target_id >= 35""",
    "resolve_channel_key": with_views("""WITH q AS (SELECT o_orderkey AS request_id, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS key FROM orders)
        SELECT request_id, key, c.c_nationkey AS tenant_id, c.c_custkey % 100 AS employee_id, CASE WHEN c.c_custkey IS NOT NULL THEN 'web' END AS channel,
        CASE WHEN c.c_custkey IS NULL THEN 'unknown key' WHEN c.c_custkey % 7 = 0 THEN 'inactive key' WHEN coalesce(t.status, '') <> 'active' THEN 'inactive tenant'
             WHEN e.c_custkey IS NULL OR e.c_custkey % 25 <> c.c_nationkey THEN 'foreign employee' END AS reason
        FROM q LEFT JOIN customer c ON c.c_custkey = q.key LEFT JOIN tenants t ON t.tenant_id = c.c_nationkey
        LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey < 100) e ON e.c_custkey = c.c_custkey % 100""", "tenants"),
    "kb_inventory": with_views(f"""WITH {_BASES} SELECT b.kb_id, coalesce(doc_count, 0) AS doc_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(d.total_bytes, 0) AS total_bytes FROM bases b
        LEFT JOIN (SELECT kb_id, count(*) AS doc_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM kb_documents WHERE kb_id <> 'src1' GROUP BY 1) d USING (kb_id)
        LEFT JOIN (SELECT kb_id, count(*) AS chunk_count FROM chunks WHERE kb_id <> 'src2' GROUP BY 1) c USING (kb_id)""", "kb_documents", "chunks"),
    "tenant_documents": with_views("SELECT d.* EXCLUDE (text), CASE WHEN kb_id = 'src4' THEN '' ELSE concat('base ', kb_id) END AS kb_name FROM kb_documents d", "kb_documents"),
    "ordered_lists": with_views("SELECT tenant_id, doc_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, doc_id) AS place FROM kb_documents", "kb_documents"),
    "purge_document": with_views(f"""WITH {_BASES}, g AS (SELECT kb_id, sum(size_bytes) AS freed FROM kb_documents WHERE doc_id % 4 = 1 GROUP BY 1)
        SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, size_bytes AS bytes FROM kb_documents WHERE doc_id % 4 <> 1
        UNION ALL SELECT 'chunk', CAST(chunk_id AS VARCHAR), 0 FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM kb_documents WHERE doc_id % 4 = 1)
        UNION ALL SELECT 'base', kb_id, CAST(greatest(0, total_bytes - coalesce(freed, 0)) AS BIGINT) FROM bases LEFT JOIN g USING (kb_id)""", "kb_documents", "chunks"),
    "purge_tenant": with_views("""SELECT 'kb_documents' AS name, CAST(tenant_id AS BIGINT) AS tenant_id, count(*) AS n FROM kb_documents WHERE tenant_id <> 2 GROUP BY 2
        UNION ALL SELECT 'chunks', tenant_id, count(*) FROM chunks WHERE tenant_id <> 2 GROUP BY 2 UNION ALL SELECT 'usage_records', tenant_id, count(*) FROM usage_records WHERE tenant_id <> 2 GROUP BY 2
        UNION ALL SELECT 'audit_logs', tenant_id, count(*) FROM audit_logs GROUP BY 2""", "kb_documents", "chunks", "usage_records", "audit_logs"),
    "purge_kb": with_views(f"""WITH {_BASES} SELECT 'bases' AS name, kb_id, count(*) AS n FROM bases WHERE kb_id NOT IN ('src1', 'src2', 'src4') GROUP BY 2
        UNION ALL SELECT 'documents', kb_id, count(*) FROM kb_documents WHERE kb_id NOT IN ('src1', 'src2', 'src4') GROUP BY 2
        UNION ALL SELECT 'chunks', kb_id, count(*) FROM chunks WHERE kb_id NOT IN ('src1', 'src2', 'src4') GROUP BY 2 UNION ALL SELECT 'refused', 'src3', 1""", "kb_documents", "chunks"),
    "orphan_rows": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 17 <> 0) GROUP BY 1",
    "constraint_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "reconcile_tables": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 19 = 0) AS m, count(*) FILTER (WHERE o_orderkey % 29 = 0) AS x,
        count(*) FILTER (WHERE o_orderkey % 19 <> 0 AND o_orderkey % 23 = 0) AS d FROM orders)
        SELECT n AS left_rows, n - m + x AS right_rows, m AS missing, x AS extra, d AS different, FALSE AS ok FROM c""",
    "employee_versions": """WITH v AS (SELECT o_custkey AS employee_id, o_orderkey AS save_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no,
        count(*) OVER (PARTITION BY o_custkey) AS last FROM orders) SELECT employee_id, save_id, version_no FROM v WHERE version_no > last - 10""",
    "evolve_schema": "SELECT o_orderkey, o_orderstatus, 'web' AS channel, 3 AS priority_no FROM orders",
    "convert_boolean": f"""WITH r AS (SELECT o_orderkey, {_RAW_BOOLEAN} AS raw FROM orders)
        SELECT o_orderkey, CASE WHEN lower(raw) IN ('1', 'yes', 'true') THEN TRUE WHEN lower(raw) IN ('f', 'no') THEN FALSE END AS value,
        CASE WHEN raw = '2' THEN 'orders.raw: not boolean: 2' END AS error FROM r""",
    "convert_integer": f"""WITH r AS (SELECT o_orderkey, {_RAW_INTEGER} AS raw FROM orders)
        SELECT o_orderkey, CASE WHEN raw IN ('3.5', '') THEN NULL ELSE CAST(CAST(trim(raw) AS DOUBLE) AS BIGINT) END AS value,
        CASE WHEN raw IN ('3.5', '') THEN concat('orders.raw: not integer: ', raw) END AS error FROM r""",
    "json_text_problems": """WITH r AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 3) WHEN event_id % 50 = 1 THEN '' ELSE props END AS props FROM events)
        SELECT event_id FROM r WHERE props <> '' AND NOT json_valid(props)""",
    "eval_summary": """WITH r AS (SELECT concat('c', doc_id % 7) AS category, concat('d', doc_id % 3) AS difficulty, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 1 THEN 'partial' ELSE 'fail' END AS verdict FROM labels)
        SELECT category, difficulty, count(*) AS total, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'partial') AS n_partial,
        count(*) FILTER (WHERE verdict = 'fail') AS n_fail, CAST(grouping(category, difficulty) AS BIGINT) AS level FROM r GROUP BY ROLLUP (category, difficulty)""",
    "snapshot_round_trip": """SELECT o_orderkey AS employee_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'none' END AS name,
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 9 AS INT) ELSE -1 END AS reply_delay_min, CAST(o_custkey % 9 + 2 AS INT) AS reply_delay_max FROM orders""",
}
