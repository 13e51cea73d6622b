"""Reading and writing: tables, text files of any encoding, sniffed CSV, evaluation cases, timing lines."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import is_identifier_row
from tidewell.operators.vectors import assert_one_dimension, vector_rows

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5", "latin-1")
DELIMITERS = (",", ";", "\t", "|")


def read_table(spark: SparkSession, name: str, path: str | None = None, schema: str | None = None, url: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table from Parquet (``path``), or from a database (``url``), there in parallel over ``partition``
    = (column, lower, upper, partitions)."""
    if url:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
        if partition:
            column, low, high, n = partition
            reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
        return reader.load()
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path or name)


def decoded(raw: bytes) -> tuple[str, str]:
    """(text, encoding): the first encoding of the list that reads the bytes."""
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads any bytes")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, text, encoding, status, error): a row per file; an empty file failed. File names pass
    through the driver, as they do in the listing of any of Spark's file sources; contents don't."""

    @F.pandas_udf("text string, encoding string")
    def decode(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(bytes(c)) for c in content], columns=["text", "encoding"])

    found = spark.read.format("binaryFile").load(path)
    rows = found.select("path", F.col("length").alias("size_bytes"), decode("content").alias("d"))
    # The scan leaves out empty files; the listing, which the reader has made anyway, has them, as encoded URIs.
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = spark.createDataFrame([(f,) for f in found.inputFiles()], "path string").select(same(plain).alias("path"))
    none = listed.join(found.select(same("path").alias("path")), "path", "left_anti")
    rows = rows.union(none.select("path", F.lit(0).cast("long"), F.struct(F.lit("").alias("text"), F.lit("utf-8").alias("encoding"))))
    empty = F.trim("d.text") == ""
    return rows.select("path", "size_bytes", "d.text", "d.encoding", F.when(empty, "failed").otherwise("success").alias("status"), F.when(empty, "empty file").otherwise("").alias("error"))


def sniff(text: str) -> tuple[str, bool]:
    """(delimiter, sure) from the first 4096 characters: the one that stands equally often, and most often,
    in each line."""
    lines = [line for line in text[:4096].split("\n")[:20] if line.strip()]
    lines = lines[:-1] if len(text) > 4096 and len(lines) > 1 else lines
    best, found = 0, ","
    for d in DELIMITERS:
        counts = {line.count(d) for line in lines}
        if len(counts) == 1 and (n := counts.pop()) > best:
            best, found = n, d
    return found, best > 0


def read_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Cells (path, row_no, col_no, value) with ``warning`` where the delimiter was a guess; a file that has
    a header only gives one row with status 'failed'."""

    @F.pandas_udf("array<struct<row_no:int,col_no:int,value:string,status:string,warning:string>>")
    def cells(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            delimiter, sure = sniff(text)
            rows = [r for r in csv.reader(io.StringIO(text.strip("﻿")), delimiter=delimiter) if any(v.strip() for v in r)]
            warning = "" if sure else "delimiter not clear, read with commas"
            if len(rows) < 2:
                out.append([{"row_no": 0, "col_no": 0, "value": None, "status": "failed", "warning": "no rows"}])
            else:
                out.append([{"row_no": i, "col_no": j, "value": v, "status": "success", "warning": warning} for i, r in enumerate(rows) for j, v in enumerate(r)])
        return pd.Series(out)

    return read_text_files(spark, path).select("path", F.explode(cells("text")).alias("c")).select("path", "c.*")


CASE = "id string, category string, sub_type string, input string, expected string, judge_criteria string, difficulty string, data_basis string"


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"cases array<struct<{CASE.replace(' string', ':string')}>>").json(path, multiLine=True)
    return rows.select(F.explode("cases").alias("c")).select("c.*")


def read_timing_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, stages map, calls map, tokens, degraded, path_name) of 'turn timing' lines: key=value pairs,
    'stage=12.5ms' or 'stage=12.5ms(x3)' for stages; a line without stages has empty maps."""
    rows = spark.read.text(path).filter(F.col("value").contains("path="))
    field = lambda name: F.regexp_extract("value", rf"(?:^|\s){name}=(\S+)", 1)
    names = F.regexp_extract_all("value", F.lit(r"(?:^|\s)([a-z_]+)=[0-9.]+ms"), F.lit(1))
    times = F.transform(F.regexp_extract_all("value", F.lit(r"(?:^|\s)[a-z_]+=([0-9.]+)ms"), F.lit(1)), lambda v: v.cast("double"))
    calls = F.transform(F.regexp_extract_all("value", F.lit(r"(?:^|\s)[a-z_]+=[0-9.]+ms(\(x[0-9]+\))?"), F.lit(1)), lambda v: F.coalesce(F.regexp_extract(v, r"x([0-9]+)", 1).try_cast("int"), F.lit(1)))
    return rows.select(F.col("value").alias("line"), F.map_from_arrays(names, times).alias("stages"), F.map_from_arrays(names, calls).alias("calls"), field("tokens").try_cast("long").alias("tokens"), (F.lower(field("degraded")).isin("1", "true", "yes")).alias("degraded"), field("path").alias("path_name"))


def write_chunks(chunks: DataFrame, path: str, salts: int = 1) -> None:
    """All chunks, a folder per tenant; ``salts`` spreads a large tenant over as many files."""
    rows = chunks.repartition("tenant_id", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)))
    rows.write.mode("overwrite").partitionBy("tenant_id").parquet(path)


def write_vectors(chunks: DataFrame, path: str, salts: int = 1) -> None:
    """Unit vectors of enabled chunks that are no identifier rows, all of one dimension."""
    rows = assert_one_dimension(vector_rows(chunks)).drop("dim")
    rows.repartition("tenant_id", F.pmod(F.xxhash64("chunk_id"), F.lit(salts))).write.mode("overwrite").partitionBy("tenant_id").parquet(path)


def write_eval_results(results: DataFrame, path: str, run_at: str) -> None:
    """Result rows as JSON lines, each with the run's total and time."""
    total = results.agg(F.count("*").alias("total"))
    results.join(F.broadcast(total)).withColumn("run_at", F.lit(run_at)).write.mode("overwrite").json(path)  # one row


def noise_share(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tenant_id").agg(F.avg(is_identifier_row("text").cast("double")).alias("share"))
