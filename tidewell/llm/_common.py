"""Helpers shared by the corpus operators: text batches, stable checkpoints, small numeric kernels."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel handles at once; temporary arrays are a small multiple of it.
SLICE_BYTES = 1 << 19
#: Rows of a batch that a step gets at once.
BATCH_ROWS = 1024
#: Folders that ``store_rows`` wrote in this session and ``scratch`` hasn't dropped.
_STORED: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, a session of one machine (as in
    tests) gets a local one; on a cluster that would be one machine's disk, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors, makes row ids stable."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_rows(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: a compact checkpoint with true sizes.
    In loops it must take the place of ``checkpoint()``, which hands the old plan's size estimates on: joins
    multiply them, and after a few rounds the planner is busy with numbers of thousands of digits."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"tidewell-{label}-{os.urandom(8).hex()}")
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops at its end what ``store_rows`` wrote inside: for use around an action that makes its result final."""
    first = len(_STORED)
    try:
        yield
    finally:
        for path in _STORED[first:]:
            drop_folder(spark, path)
        del _STORED[first:]


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow`` in batches of at most ``rows`` rows. At the end of a task its worker hands freed memory
    back: workers live on and would otherwise keep the most that any of their tasks took."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, max(batch.num_rows, 1), rows):
                yield batch.slice(first, rows)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(small(batches))
        finally:
            hand_back_memory()

    return df.mapInArrow(own, schema)


def hand_back_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def pack_text(df: DataFrame) -> DataFrame:
    """``df`` with its text column compressed (null as empty): what checkpoints and shuffles then carry is
    less than half as large. ``unpack_text`` undoes it inside a task."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` " + ("binary" if f.name == "text" else f.dataType.simpleString()) for f in df.schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([press.compress(raw) for raw in column_bytes(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if n == "text" else batch.column(n) for n in names], names)

    return map_batches(df, step, schema)


def unpack_text(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows with the text column as bytes again."""
    open_up = zstandard.ZstdDecompressor()
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            at = part.schema.get_field_index("text")
            texts = pa.array([open_up.decompress(raw) for raw in part.column(at).to_pylist()], pa.large_binary())
            columns = list(part.columns)
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)


def is_training_row(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is not 2; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, uint8 buffer, row offsets) over runs of at most ``rows`` rows of about ``limit``
    bytes. Null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) else b"")
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(values), first + rows)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def column_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Values of a string column as UTF-8 bytes, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return []
    empty = "" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b""
    return (values.fill_null(empty) if values.null_count else values).cast(pa.large_binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits (public constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit random value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def odd_powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def stable_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns of the input can't reach a join."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of about ``limit`` labelled training rows (all where there are fewer), chosen by a
    hash of doc_id among the ids of ``labels``. Only ids and labels are broadcast: 2 * ``limit`` rows at most.
    """
    known = (
        stable_columns(labels, "doc_id", label)
        .filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & is_training_row())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    count = known.count()
    share = min(1.0, limit / max(count, 1))
    u = F.pmod(F.xxhash64(F.lit(101), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    known = known.filter(u < share).limit(2 * limit)
    return stable_columns(documents, "doc_id", "text").join(F.broadcast(known), "doc_id").limit(4 * limit)


def fold(documents: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all further columns in one struct, where their names can't clash."""
    rest = [F.col(f"`{c}`").alias(c) for c in documents.columns if c not in ("doc_id", "text")]
    return documents.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("tidewell_end")).alias("rest"))


def unfold(folded: DataFrame, columns: list[str], changed: Column | None = None) -> DataFrame:
    """The columns as they were; where ``changed`` holds, ``n_chars`` follows the text."""
    out = []
    for c in columns:
        value = F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c)
        if c == "n_chars" and changed is not None:
            value = F.when(changed, F.length("text").cast(folded.schema["rest"].dataType[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return folded.select(*out)
