"""Exact duplicates by a content sort.

Spark samples keys, chooses splitters and range-partitions the texts by them; each range is sorted externally, so that
equal texts stand next to each other, and neighbours are compared in full. The sampled key is short (a text's first
characters and a 64-bit mark of all of it), so the sample stays small whatever the texts are. A mark that very many rows
have gets slots, between which splitters can fall: the runs of its slots are then compared with each other, in full too.
Texts are moved once. Only built-in expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._common import store_rows

#: Characters of a text that lead its sort key.
HEAD = 32
#: Marks at most that get slots; where more rows come, slots grow instead (n rows have at most n / h marks of h rows).
MOST_HOT = 100_000


def squeezed(text: Column) -> Column:
    """A normal form for ``exact_groups``: lower case, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def exact_groups(documents: DataFrame, normalise: Callable[[Column], Column] | None = None, slot_rows: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: of rows whose normalised texts are equal in every
    byte, the one with the largest doc_id is kept.

    Null texts count as empty ones and are equal to them; a null doc_id is smaller than any other; of rows with the
    same text and the same largest doc_id exactly one is kept. Texts of any length are compared whole. An empty table
    gives no rows; other columns of ``documents``, whatever their names, take no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (normalise(text) if normalise else text).alias("text"))
    rows = rows.withColumns({"uid": F.monotonically_increasing_id(), "mark": F.xxhash64("text"), "head": F.substring("text", 1, HEAD)})
    slot_rows = max(slot_rows, -(-documents.count() // MOST_HOT))
    hot = rows.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") > slot_rows)
    hot = hot.select("mark", F.ceil(F.col("n") / slot_rows).alias("slots")).collect()  # MOST_HOT rows at most
    slots = documents.sparkSession.createDataFrame([tuple(r) for r in hot], "mark long, slots long")
    dealt = rows.join(F.broadcast(slots), "mark", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("uid"), "slots"), F.lit(0).cast("long")))

    equal = Window.partitionBy("head", "mark", "slot", "text")
    runs = dealt.repartitionByRange("head", "mark", "slot").withColumns({"n": F.count("*").over(equal), "last": F.max(F.struct("doc_id", "uid")).over(equal)})
    runs = runs.select("doc_id", "uid", "n", "last", "slots", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("slots").isNotNull() & (F.col("uid") == F.col("last.uid")), F.col("text")).alias("text"))
    if hot:
        runs = store_rows(runs, "runs")
        whole = runs.filter(F.col("text").isNotNull()).groupBy("text", "text_sha256").agg(F.sum("n").alias("all_n"), F.max("last").alias("all_last")).drop("text")
        runs = runs.join(F.broadcast(whole), "text_sha256", "left")  # a row per text of a hot mark
        runs = runs.withColumns({"n": F.coalesce("all_n", "n"), "last": F.coalesce("all_last", "last")})
    return runs.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("last.uid")).alias("kept"), "text_sha256")
