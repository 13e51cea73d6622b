"""Tenant scope, bindings, channel keys, upload admission and document lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.folds import fold_in_order

#: Limits of one knowledge base (fixed values).
MAX_FILE_BYTES, MAX_DOCS, MAX_KB_BYTES = 20 * 1024 * 1024, 500, 1024**3
EXTENSIONS = ("txt", "md", "csv", "json", "pdf", "docx", "xlsx", "xls")


def tenant_scope(rows: DataFrame, tenant_id, **equal) -> DataFrame:
    """Rows of one tenant; without a tenant this raises instead of reading everything."""
    if tenant_id is None or tenant_id == "":
        raise ValueError("a tenant is needed")
    out = rows.filter(F.col("tenant_id") == F.lit(tenant_id))
    for name, value in equal.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def assert_same_tenant(rows: DataFrame, tenant_id) -> tuple[DataFrame, DataFrame]:
    """(own rows, rejected rows); a null tenant is rejected."""
    if tenant_id is None or tenant_id == "":
        raise ValueError("a tenant is needed")
    own = F.col("tenant_id").eqNullSafe(F.lit(tenant_id))
    return rows.filter(own), rows.filter(~own)


def set_document_enabled(chunks: DataFrame, toggles: DataFrame) -> DataFrame:
    """Chunks with the state of their document's toggle (doc_id, enabled), where there is one."""
    new = toggles.select("doc_id", F.col("enabled").alias("new_enabled"))
    return chunks.join(new, "doc_id", "left").withColumn("enabled", F.coalesce("new_enabled", "enabled")).drop("new_enabled")


def _stateless_reason(max_bytes: int) -> Column:
    extension = F.lower(F.element_at(F.split("filename", r"\."), -1))
    return F.when(~F.col("filename").contains(".") | ~extension.isin(*EXTENSIONS), "extension").when(F.col("size_bytes") > max_bytes, "size").when(F.col("size_bytes") <= 0, "empty")


def admit_uploads(uploads: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Uploads with the first rule that refuses each (null: admitted): extension, size, empty, or a file of
    the same tenant, base, name and size that came earlier and was not refused by those rules."""
    rows = uploads.withColumn("reason", _stateless_reason(max_bytes))
    earlier = Window.partitionBy("tenant_id", "kb_id", "filename", "size_bytes", F.col("reason").isNull()).orderBy("created_at", "doc_id")
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(earlier) > 1), "duplicate").otherwise(F.col("reason")))


def admit_with_caps(uploads: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_docs: int = MAX_DOCS, max_kb_bytes: int = MAX_KB_BYTES) -> DataFrame:
    """``admit_uploads`` plus the caps of a base on documents and bytes. A refused file leaves the state as
    it was, so the caps are folded in arrival order: a base is one task that streams its files and holds two sums."""

    def decide(state: dict, reason: str | None, size: int) -> str | None:
        if reason is None:
            reason = "documents" if state["docs"] >= max_docs else "bytes" if state["bytes"] + size > max_kb_bytes else None
            if reason is None:
                state["docs"] += 1
                state["bytes"] += size
        return reason

    rows = admit_uploads(uploads, max_bytes).withColumnRenamed("reason", "refused")
    decided = fold_in_order(rows, ["tenant_id", "kb_id"], ["created_at", "doc_id"], ["refused", "size_bytes"], lambda: {"docs": 0, "bytes": 0}, decide, "reason", "string")
    return decided.drop("refused")


def first_document_wins(uploads: DataFrame) -> DataFrame:
    first = Window.partitionBy("kb_id", "filename", "size_bytes").orderBy("created_at", "doc_id")
    return uploads.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def chunks_with_filename(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    names = documents.select("doc_id", "filename")
    return chunks.join(names, "doc_id", "left").withColumn("filename", F.coalesce("filename", F.lit("")))


def verify_hits(hits: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits whose chunk exists, is enabled and of the same tenant; the rejected rest)."""
    alive = chunks.filter("enabled").select("tenant_id", "chunk_id")
    return hits.join(alive, ["tenant_id", "chunk_id"], "left_semi"), hits.join(alive, ["tenant_id", "chunk_id"], "left_anti")


def resolve_scope(employees: DataFrame, kb_bindings: DataFrame, doc_bindings: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """(employee_id, scope_kind, scope_id): an override list wins (employees listed in ``override`` with a
    null scope_id retrieve nothing), then bound bases, then bound documents of employees without a base."""
    people = employees.select("employee_id")
    parts = []
    if override is not None:
        parts.append(override.filter(F.col("scope_id").isNotNull()).select("employee_id", F.lit("kb").alias("scope_kind"), F.col("scope_id").cast("string")))
        people = people.join(override.select("employee_id"), "employee_id", "left_anti")
    kbs = people.join(kb_bindings, "employee_id").select("employee_id", F.lit("kb").alias("scope_kind"), F.col("kb_id").cast("string").alias("scope_id"))
    rest = people.join(kb_bindings, "employee_id", "left_anti")
    docs = rest.join(doc_bindings, "employee_id").select("employee_id", F.lit("doc").alias("scope_kind"), F.col("doc_id").cast("string").alias("scope_id"))
    for part in (kbs, docs):
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def validate_bindings(requested: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) bindings by (tenant_id, target_id)."""
    keys = ["tenant_id", "target_id"]
    return requested.join(own.select(*keys), keys, "left_semi"), requested.join(own.select(*keys), keys, "left_anti")


def binding_diff(current: DataFrame, requested: DataFrame, own: DataFrame) -> DataFrame:
    """(employee_id, target_id, action): add, keep, remove or reject."""
    keys = ["employee_id", "target_id"]
    rejected = requested.join(own.select("target_id"), "target_id", "left_anti").select(*keys)
    wanted = requested.select(*keys).exceptAll(rejected).distinct()
    now = current.select(*keys).distinct()
    parts = [(wanted.subtract(now), "add"), (wanted.intersect(now), "keep"), (now.subtract(wanted), "remove"), (rejected.distinct(), "reject")]
    out = None
    for rows, action in parts:
        rows = rows.withColumn("action", F.lit(action))
        out = rows if out is None else out.union(rows)
    return out


def resolve_channel_key(requests: DataFrame, keys: DataFrame, tenants: DataFrame, employees: DataFrame) -> DataFrame:
    """Requests with tenant, employee and channel of their key, and why a key is refused (null: accepted)."""
    known = keys.select("key", "tenant_id", "employee_id", "channel", F.col("status").alias("key_status"))
    tenant = tenants.select("tenant_id", F.col("status").alias("tenant_status"))
    person = employees.select("employee_id", F.col("tenant_id").alias("employee_tenant"))
    rows = requests.join(known, "key", "left").join(tenant, "tenant_id", "left").join(person, "employee_id", "left")
    reason = (
        F.when(F.col("key_status").isNull(), "unknown key")
        .when(F.col("key_status") != "active", "inactive key")
        .when(F.coalesce("tenant_status", F.lit("")) != "active", "inactive tenant")
        .when(F.col("employee_id").isNotNull() & ~F.col("employee_tenant").eqNullSafe(F.col("tenant_id")), "foreign employee")
    )
    return rows.select("request_id", "key", "tenant_id", "employee_id", "channel", reason.alias("reason"))


def kb_inventory(bases: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks and bytes per base, 0 where none; both sides are aggregated before they meet."""
    docs = documents.groupBy("kb_id").agg(F.count("*").alias("doc_count"), F.sum("size_bytes").alias("total_bytes"))
    parts = chunks.groupBy("kb_id").agg(F.count("*").alias("chunk_count"))
    rows = bases.join(docs, "kb_id", "left").join(parts, "kb_id", "left")
    return rows.select("kb_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("doc_count", "chunk_count", "total_bytes")])


def tenant_documents(documents: DataFrame, bases: DataFrame) -> DataFrame:
    """Documents with their base's name ('' where it is gone), newest first."""
    names = bases.select("kb_id", "kb_name")
    rows = documents.join(names, "kb_id", "left").withColumn("kb_name", F.coalesce("kb_name", F.lit("")))
    return rows.orderBy(F.desc("created_at"), "doc_id")


def ordered_lists(documents: DataFrame) -> DataFrame:
    """Documents numbered newest first within their tenant."""
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), "doc_id")
    return documents.select("tenant_id", "doc_id", F.row_number().over(newest).alias("place"))


def publish_checks(employees: DataFrame, kb_bindings: DataFrame, doc_bindings: DataFrame, documents: DataFrame, unknown: Column) -> DataFrame:
    """(employee_id, blocked, confirm): blocked by a blank persona or unknown variables (``unknown``: an
    array column over employees); to be confirmed where nothing is bound or no bound document is enabled.
    Here document bindings are looked at first."""
    live = documents.filter("enabled")
    by_doc = doc_bindings.join(live.select("doc_id"), "doc_id", "left_semi").select("employee_id").distinct().withColumn("doc_live", F.lit(True))
    by_kb = kb_bindings.join(live.select("kb_id").distinct(), "kb_id", "left_semi").select("employee_id").distinct().withColumn("kb_live", F.lit(True))
    has_doc = doc_bindings.select("employee_id").distinct().withColumn("has_doc", F.lit(True))
    has_kb = kb_bindings.select("employee_id").distinct().withColumn("has_kb", F.lit(True))
    rows = employees
    for side in (has_doc, has_kb, by_doc, by_kb):
        rows = rows.join(side, "employee_id", "left")
    blocked = F.array_compact(F.array(F.when(F.trim(F.coalesce("persona", F.lit(""))) == "", "persona is blank"), F.when(F.size(unknown) > 0, F.concat(F.lit("unknown variables: "), F.array_join(unknown, ", ")))))
    confirm = F.array_compact(
        F.array(
            F.when(F.col("has_doc").isNull() & F.col("has_kb").isNull(), "nothing is bound"),
            F.when(F.col("has_doc").isNotNull() & F.col("doc_live").isNull(), "no bound document is enabled"),
            F.when(F.col("has_doc").isNull() & F.col("has_kb").isNotNull() & F.col("kb_live").isNull(), "no bound document is enabled"),
        )
    )
    return rows.select("employee_id", blocked.alias("blocked"), confirm.alias("confirm"))


def claim_images(messages: DataFrame, images: DataFrame, limit: int = 3) -> DataFrame:
    """(message_id, pos, image_id, session_id): the first ``limit`` distinct image ids of each message that
    belong to its tenant and visitor; others are skipped."""
    wanted = messages.select("message_id", "session_id", "tenant_id", "visitor_id", F.posexplode(F.slice(F.array_distinct("image_ids"), 1, limit)).alias("pos", "image_id"))
    own = images.select("image_id", "tenant_id", "visitor_id")
    return wanted.join(own, ["image_id", "tenant_id", "visitor_id"]).select("message_id", "pos", "image_id", "session_id")


def messages_with_image_text(messages: DataFrame, images: DataFrame) -> DataFrame:
    """(message_id, content) with the text of the tenant's own images named in ``meta`` appended in order."""
    parsed = messages.withColumn("image", F.from_json("meta", "images array<struct<id:string>>"))
    refs = parsed.select("message_id", "tenant_id", F.posexplode("image.images.id").alias("pos", "image_id"))
    found = refs.join(images.filter(F.trim(F.coalesce("ocr_text", F.lit(""))) != "").select("image_id", "tenant_id", "ocr_text"), ["image_id", "tenant_id"])
    texts = found.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ocr_text"))), lambda x: x["ocr_text"]), "\n").alias("extra"))
    rows = messages.join(texts, "message_id", "left")
    return rows.select("message_id", F.concat_ws("\n", "content", "extra").alias("content"))
