"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them, ranges
that came out overfull are sampled again and subdivided, and exact sizes per range then turn positions in
the key order into shards of near equal weight. Whole records are stored once (texts compressed); planning
reads five numbers a record of them, and a last pass moves the records to their ranges, in the order of
their slots. The sample, the boundaries and the per-range sums are bounded by the number of ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._common import fold, map_batches, pack_text, store_rows, unpack_text

#: Ranges at most: from there on they grow instead, so that the sample on the driver (24 keys a range) doesn't.
MOST_RANGES = 40_000
ORDER = ("doc_id", "text_crc32", "size", "uid")


def _draw(rows: DataFrame, chance, seed: int) -> list[tuple]:
    """Keys of records kept with probability ``chance`` (a column), by a hash of the record's number."""
    u = F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(1 << 52)) / float(1 << 52)
    return sorted(_key(r) for r in rows.filter(u < chance).select(*ORDER).collect())


def _key(row) -> tuple:
    return (row.doc_id is not None, row.doc_id or 0, row.text_crc32, row.size, row.uid)


def _with_range(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(splitters)

    @F.pandas_udf("int")
    def range_of(present: pd.Series, doc_id: pd.Series, crc: pd.Series, size: pd.Series, uid: pd.Series) -> pd.Series:
        cuts = held.value
        return pd.Series([bisect_right(cuts, k) for k in zip(present, doc_id, crc, size, uid)], dtype="int32")

    return rows.withColumn("range", range_of(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "text_crc32", "size", "uid"))


def _sums(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    return {r["range"]: (r.w, r.n) for r in ranged.groupBy("range").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}


def shard_documents(
    documents: DataFrame,
    n_shards: int = 24,
    law: str = "bytes",
    rows_per_range: int = 1_000_000,
    draws_per_range: int = 24,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, record) for every record; ``record`` is a
    struct of all columns of ``documents`` as they were. Rows of a partition stand in the order of their slots.

    ``law``: ``bytes`` makes shard sizes near equal (apart by less than two records), ``rows`` the counts.
    Size is the text's UTF-8 bytes plus 8, null text as empty. Records are ordered by doc_id (null first),
    checksum, size and a record number, so equal records, equal ids and null ids are split like any others.
    Empty and very long texts are records like any other; one long record may fill a shard.
    Slots run from 0 without gaps in each shard. An empty table gives no rows. Extra columns take no part in the order.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    records = fold(documents).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("text").isNull().alias("no_text"),
        "text",
        "rest",
    )
    records = pack_text(records).withColumn("uid", F.monotonically_increasing_id())
    records = store_rows(records.withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long")), "records")
    rows = records.select(*ORDER, "weight")

    total, count = rows.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    n_ranges = max(8 * n_shards, min(-(-count // rows_per_range), MOST_RANGES))
    fair = max(1, total // n_ranges)
    draws = n_ranges * draws_per_range
    sample = _draw(rows, F.col("weight") * draws / F.lit(float(max(total, 1))), seed)
    splitters = sorted({sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)}) if sample else []
    for again in range(1, 4):  # subdivide what came out overfull
        ranged = _with_range(rows, splitters)
        sums = _sums(ranged)
        full = {k: w for k, (w, n) in sums.items() if w > 2 * fair and n > 64}
        if not full:
            break
        held = F.when(F.col("range").isin(sorted(full)), F.lit(float(draws_per_range) / fair)).otherwise(0.0)
        more = _draw(ranged, F.col("weight") * held, seed + again)
        splitters = sorted({*splitters, *more[:: max(1, draws_per_range)]})
    sums = _sums(_with_range(rows, splitters))

    offsets, w0, n0 = [], 0, 0
    for k in sorted(sums):
        offsets.append((k, w0, n0))
        w0, n0 = w0 + sums[k][0], n0 + sums[k][1]
    before = rows.sparkSession.createDataFrame(offsets, "range int, w0 long, n0 long")
    in_range = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "uid")
    def place(some: DataFrame) -> DataFrame:
        return (
            _with_range(some, splitters)
            .join(F.broadcast(before), "range")  # a row per range
            .withColumn("past", F.col("w0") + F.sum("weight").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
            .withColumn("place", F.col("n0") + F.row_number().over(in_range) - 1)
            .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(2 * past + weight) * {n_shards} div {2 * max(total, 1)}").cast("int")))
        )

    first = place(rows).groupBy("shard").agg(F.min("place").alias("first")).collect()  # a row per shard
    first = rows.sparkSession.createDataFrame([tuple(r) for r in first], "shard int, first long")
    placed = place(records).join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), "no_text", "text", "rest"
    )
    kinds = {f.name: f.dataType for f in documents.schema.fields}
    values = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.when(~F.col("no_text"), F.col("text"))}
    record = F.struct(*[values.get(c, F.col("rest").getField(c)).alias(c) for c in documents.columns])
    return _with_text(placed).select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), record.alias("record"))


def _with_text(placed: DataFrame) -> DataFrame:
    """``placed`` with its texts as strings again."""
    names = placed.columns
    schema = ", ".join(f"`{f.name}` " + ("string" if f.name == "text" else f.dataType.simpleString()) for f in placed.schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpack_text(batches):
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if n == "text" else c for n, c in zip(names, batch.columns)], names)

    return map_batches(placed, step, schema)


def write_shards(placed: DataFrame, path: str) -> None:
    """Whole records of ``shard_documents`` as Parquet: a folder per shard, rows (slot, record)."""
    placed.select("shard", "slot", "record").write.partitionBy("shard").parquet(path)
