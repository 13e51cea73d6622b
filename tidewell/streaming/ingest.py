"""Documents as a stream into chunk, vector and status tables that hold each file's newest upload once.

Tables are kept by tenant. A batch rewrites the tenants that it touches into folders of its own number, and its manifest,
written last, says that they hold these tenants from now on; other tenants stay where they are. A batch that comes again
(after a lost driver, say) starts from the versions before it and overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.chunking import chunk_blocks_udf
from tidewell.functions.text import is_identifier_row, strip_meta
from tidewell.operators.documents import prepare_document
from tidewell.operators.folds import small_side
from tidewell.operators.vectors import hash_embed
from tidewell.sources.shared import drop_folder

FILE = ["tenant_id", "kb_id", "filename"]
TABLES = ("chunks", "vectors", "status")
#: How a record block begins (fixed value).
RECORD = "^【[^】]+】[^：:]{1,40}[：:]"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _versions(spark: SparkSession, path: str, before: int | None) -> DataFrame | None:
    """(tenant_id, batch): the batch that holds each tenant's rows, of batches before ``before`` (None: all)."""
    if not _there(spark, f"{path}/manifest"):
        return None
    rows = spark.read.schema("tenant_id long, batch long").parquet(f"{path}/manifest")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.groupBy("tenant_id").agg(F.max("batch").alias("batch"))


def _current(spark: SparkSession, path: str, table: str, versions: DataFrame) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{table}")
    rows = rows.withColumns({"tenant_id": F.col("tenant_id").cast("long"), "batch": F.col("batch").cast("long")})
    return rows.join(small_side(versions), ["tenant_id", "batch"]).drop("batch")


def ingested(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``chunks``, ``vectors`` or ``status`` of ``ingest_stream`` as they are now."""
    return _current(spark, path, table, _versions(spark, path, None))


def ingest_batch(files: DataFrame, number: int, path: str, size: int = 600, overlap: int = 100, dim: int = 64) -> None:
    """One batch of uploads (doc_id, tenant_id, kb_id, filename, text). An upload replaces the earlier one of its tenant,
    base and file name (in a batch the larger doc_id counts); rows of other tenants are never read for it. Documents are
    prepared whole (derived blocks first), then cut. A file without text is a status row 'failed' and stops no other.
    Keys must not be null."""
    spark = files.sparkSession
    newest = F.row_number().over(Window.partitionBy(*FILE).orderBy(F.desc("doc_id")))
    own = files.withColumn("nth", newest).filter("nth = 1").select("doc_id", *[F.col(c).cast("long" if c == "tenant_id" else "string").alias(c) for c in FILE], "text")
    own = own.withColumn("file_id", F.sha2(F.to_json(F.struct(*FILE)), 256))
    work = f"{path}/work-{number}"
    parts = F.split("text", r"\n\s*\n")  # records are blocks of their own, running text is cut by size
    parts = F.when(F.exists(parts, lambda p: p.rlike(RECORD)), parts).otherwise(F.array("text"))
    blocks = own.select(F.col("file_id").alias("doc_id"), F.posexplode(parts).alias("seq", "text")).filter(F.col("text").isNotNull())
    prepared = prepare_document(own.select(F.col("file_id").alias("doc_id"), "filename"), blocks).groupBy("doc_id")
    prepared = prepared.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("blocks"))
    pieces = prepared.select(F.col("doc_id").alias("file_id"), chunk_blocks_udf(size, overlap)("blocks").alias("pieces"))
    own.drop("text").join(pieces, "file_id", "left").withColumn("pieces", F.coalesce("pieces", F.array().cast("array<string>"))).write.mode("overwrite").parquet(work)
    own = spark.read.parquet(work)

    chunks = own.select("doc_id", *FILE, "file_id", F.posexplode("pieces").alias("seq", "text"))
    chunks = chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", "file_id", "seq"), 256))
    vectors = hash_embed(chunks.filter(~is_identifier_row("text")).withColumn("bare", strip_meta("text")), "bare", dim).drop("bare", "text", "seq")
    failed = F.size("pieces") == 0
    status = own.select("doc_id", *FILE, "file_id", F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, "no text").alias("reason"), F.size("pieces").alias("chunk_count"))

    touched = own.select("tenant_id").distinct()
    before = _versions(spark, path, number)
    held = before.join(touched, "tenant_id", "left_semi") if before is not None else None
    for table, new in zip(TABLES, (chunks, vectors, status)):
        if held is not None and _there(spark, f"{path}/{table}"):
            kept = _current(spark, path, table, held).join(own.select("file_id"), "file_id", "left_anti")
            new = kept.unionByName(new.select(kept.columns))
        new.repartition("tenant_id", F.pmod(F.xxhash64("file_id"), F.lit(64))).write.mode("overwrite").partitionBy("tenant_id").parquet(f"{path}/{table}/batch={number}")
    touched.write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
    drop_folder(spark, work)


def ingest_stream(files: DataFrame, path: str, state: str, size: int = 600, overlap: int = 100, dim: int = 64) -> None:
    """Drain a stream of uploads by ``ingest_batch``; ``ingested`` reads the tables, ``drop_replaced`` frees the folders
    of versions that no longer count."""
    query = files.writeStream.foreachBatch(lambda rows, number: ingest_batch(rows, number, path, size, overlap, dim)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete whole batches none of whose tenants' versions count; how many. Not while a stream runs."""
    rows = spark.read.schema("tenant_id long, batch long").parquet(f"{path}/manifest")
    used = _versions(spark, path, None).select("batch").distinct()
    gone = [r.batch for r in rows.select("batch").distinct().join(used, "batch", "left_anti").collect()]  # numbers of batches
    for number in gone:
        for table in (*TABLES, "manifest"):
            drop_folder(spark, f"{path}/{table}/batch={number}")
    return len(gone)
