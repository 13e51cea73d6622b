"""Purges, orphans, reconciliation, constraint checks, conversions and evaluation summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import round_even

def purge_tenant(tables: dict[str, DataFrame], tenant_id, keep: tuple[str, ...] = ("audit_logs",)) -> dict[str, DataFrame]:
    """All tables without the tenant's rows; audit rows stay."""
    return {n: t if n in keep else t.filter(~F.col("tenant_id").eqNullSafe(F.lit(tenant_id))) for n, t in tables.items()}


def purge_document(documents: DataFrame, chunks: DataFrame, bases: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, bases) after the documents are gone; a base's bytes don't fall under zero."""
    gone = documents.join(doc_ids, "doc_id", "left_semi").groupBy("kb_id").agg(F.sum("size_bytes").alias("freed"))
    lower = bases.join(gone, "kb_id", "left").withColumn("total_bytes", F.greatest(F.lit(0), F.col("total_bytes") - F.coalesce("freed", F.lit(0)))).drop("freed")
    return documents.join(doc_ids, "doc_id", "left_anti"), chunks.join(doc_ids, "doc_id", "left_anti"), lower


def purge_kb(bases: DataFrame, documents: DataFrame, chunks: DataFrame, bindings: DataFrame, kb_ids: DataFrame) -> dict[str, DataFrame]:
    """Bases, documents and chunks after the purge; a base that an employee is bound to is refused."""
    refused = kb_ids.join(bindings.select("kb_id").distinct(), "kb_id", "left_semi")
    gone = kb_ids.join(bindings.select("kb_id").distinct(), "kb_id", "left_anti")
    return {"bases": bases.join(gone, "kb_id", "left_anti"), "documents": documents.join(gone, "kb_id", "left_anti"), "chunks": chunks.join(gone, "kb_id", "left_anti"), "refused": refused}


def orphan_rows(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def constraint_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def reconcile_tables(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows on both sides, missing, extra and differing keys, and whether all is equal. All other
    columns are compared by one 64-bit hash, after which only keys and hashes are shuffled."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        nulls = F.array(*[F.col(c).isNull() for c in rest]) if rest else F.array(F.lit(False))
        return df.select(*keys, F.xxhash64(*rest, nulls).alias(name))

    both = hashed(left, "l").join(hashed(right, "r"), keys, "full_outer")
    out = both.agg(
        F.count("l").alias("left_rows"), F.count("r").alias("right_rows"), F.count_if(F.col("r").isNull()).alias("missing"),
        F.count_if(F.col("l").isNull()).alias("extra"), F.count_if(F.col("l") != F.col("r")).alias("different"),
    )
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("different") == 0))


def employee_versions(saves: DataFrame, keep: int = 10) -> DataFrame:
    """Saves numbered 1.. per employee in time order, the newest ``keep`` of them."""
    order = Window.partitionBy("employee_id").orderBy("saved_at", "save_id")
    newest = Window.partitionBy("employee_id")
    rows = saves.withColumn("version_no", F.row_number().over(order)).withColumn("last", F.max("version_no").over(newest))
    return rows.filter(F.col("version_no") > F.col("last") - keep).drop("last")


def next_versions(current: DataFrame, saves: DataFrame) -> DataFrame:
    """New saves numbered after the employee's greatest version so far."""
    top = current.groupBy("employee_id").agg(F.max("version_no").alias("top"))
    order = Window.partitionBy("employee_id").orderBy("saved_at", "save_id")
    rows = saves.join(top, "employee_id", "left")
    return rows.withColumn("version_no", F.coalesce("top", F.lit(0)) + F.row_number().over(order)).drop("top")


def evolve_schema(rows: DataFrame, schema: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Rows with exactly the columns of ``schema`` (name -> type): missing ones get their default, unknown
    ones go."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(defaults.get(c))).cast(t).alias(c) for c, t in schema.items()])


BOOLEANS = {"1": True, "true": True, "t": True, "yes": True, "0": False, "false": False, "f": False, "no": False}


def convert_column(rows: DataFrame, column: str, kind: str, table: str) -> DataFrame:
    """``rows`` with ``value`` (converted) and ``error`` ('table.column: ...' where it can't be); null
    passes. Stricter than a cast: 2 is no boolean, 3.5 and '' are no integers, an empty time is an error."""
    raw = F.col(column).cast("string")
    text = F.trim(raw)
    if kind == "boolean":
        value = reduce(lambda acc, kv: acc.when(F.lower(text) == kv[0], F.lit(kv[1])), BOOLEANS.items(), F.when(F.lit(False), F.lit(None).cast("boolean")))
    elif kind == "integer":
        value = F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("bigint"))
    elif kind == "datetime":
        value = text.try_cast("timestamp").cast("timestamp_ntz")
    elif kind == "text":
        value = raw
    else:
        raise ValueError(f"unknown type {kind!r}")
    bad = raw.isNotNull() & value.isNull()
    return rows.withColumns({"value": value, "error": F.when(bad, F.concat(F.lit(f"{table}.{column}: not {kind}: "), raw))})


def json_text_problems(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither empty nor JSON."""
    text = F.trim(F.col(column))
    return rows.filter((text != "") & F.try_parse_json(text).isNull())


def eval_summary(results: DataFrame) -> DataFrame:
    """Verdict counts overall, by category, and by category and difficulty."""
    counted = results.rollup("category", "difficulty").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "partial", "fail")], F.grouping_id().alias("level")
    )
    return counted


def snapshot_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(employee_id, snapshot): the configuration as one JSON text."""
    return rows.select("employee_id", F.to_json(F.struct(*columns)).alias("snapshot"))


def apply_snapshot(rows: DataFrame, snapshots: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the fields that their snapshot holds; fields it lacks stay. A legacy single delay gives
    both ends of the range where the range is missing."""
    parsed = snapshots.select("employee_id", F.from_json("snapshot", schema).alias("s"))
    joined = rows.join(parsed, "employee_id", "left")
    names = parsed.schema["s"].dataType.names
    legacy = {"reply_delay_min": "reply_delay", "reply_delay_max": "reply_delay"}
    out = []
    for c in rows.columns:
        if c in names:
            options = [F.col(f"s.{c}")] + ([F.col(f"s.{legacy[c]}")] if legacy.get(c) in names else []) + [F.col(c)]
            out.append(F.coalesce(*options).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def refuse_stats(messages: DataFrame, refuses: Column) -> DataFrame:
    """Share of AI messages that refuse, by tenant."""
    return messages.filter(F.col("role") == "ai").groupBy("tenant_id").agg(F.count("*").alias("replies"), round_even(F.avg(refuses.cast("double")), 6).alias("refuse_rate"))
