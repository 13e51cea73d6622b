"""A stored vector index: centroids per scope, cells as table partitions, probes, exact scores of what they open.

``build_index`` trains centroids on a bounded sample of each scope (tenant_id, kb_id) and writes every vector under its
nearest one; ``search_index`` compares queries with their scope's centroids, opens the nearest cells only and scores what
stands there exactly. A scope of up to ``cell_rows`` chunks is one cell, in which the search is exact; with ``probes``
of None all cells are opened. ``calibrate_probes`` measures how many give the recall that is wanted.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.folds import small_side
from tidewell.operators.vectors import _best_of_block, _matrix, block_similarity_join

SCOPE = ["tenant_id", "kb_id"]
#: Cells of a scope at most, and sampled vectors for each: 32,768 vectors train one scope in one task.
MOST_CELLS, SAMPLE_PER_CELL = 1024, 32
ROUNDS = 8
#: Vectors that are compared with their scope's centroids in one group.
BLOCK = 8_000
CENTROIDS = "tenant_id long, kb_id long, cell int, centroid array<float>"


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means over one scope's sample, from vectors far from each other."""
    cells = int(rows["cells"].iloc[0])
    rows = rows.sort_values("chunk_id", kind="stable")
    width = rows["embedding"].map(len).mode().iloc[0]  # vectors of another width are alike to none
    points = _matrix(rows[rows["embedding"].map(len) == width], "embedding")
    cells = min(cells, len(points))
    chosen, nearest = [0], points @ points[0]
    while len(chosen) < cells:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(ROUNDS):
        own = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return pd.DataFrame({"tenant_id": rows["tenant_id"].iloc[0], "kb_id": rows["kb_id"].iloc[0], "cell": np.arange(cells, dtype=np.int32), "centroid": list(centres.astype(np.float32))})


def train_centroids(chunks: DataFrame, cell_rows: int) -> DataFrame:
    """(tenant_id, kb_id, cell, centroid) for chunks of one or more cells' size per scope, from at most
    ``MOST_CELLS * SAMPLE_PER_CELL`` vectors of each, those of smallest hash."""
    counts = chunks.groupBy(*SCOPE).agg(F.least(F.ceil(F.count("*") / cell_rows), F.lit(MOST_CELLS)).cast("int").alias("cells"), F.count("*").alias("n"))
    u = F.pmod(F.xxhash64(F.lit(3), "chunk_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.least(F.lit(1.0), 2.0 * F.col("cells") * SAMPLE_PER_CELL / F.col("n"))  # cuts the sample before the window does exactly
    first = Window.partitionBy(*SCOPE).orderBy(F.xxhash64(F.lit(3), "chunk_id"), "chunk_id")
    sample = chunks.select(*SCOPE, "chunk_id", "embedding").join(small_side(counts), SCOPE).filter((u < share) | (F.col("n") <= F.col("cells") * SAMPLE_PER_CELL))
    sample = sample.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= F.col("cells") * SAMPLE_PER_CELL)
    return sample.select(*SCOPE, "chunk_id", "embedding", "cells").groupBy(*SCOPE).applyInPandas(_train, CENTROIDS)


def _nearest_cells(rows: DataFrame, key: str, centroids: DataFrame, probes: int) -> DataFrame:
    """(key, tenant_id, kb_id, cell): the ``probes`` nearest cells of each row's scope. Rows are dealt into blocks by a
    hash of their key, each of which meets the scope's centroids once."""
    counted = rows.groupBy(*SCOPE).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.select(F.col(key).alias("query_id"), *SCOPE, F.col("embedding").alias("q")).join(small_side(counted), SCOPE)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).drop("blocks")
    met = centroids.join(small_side(counted.select("*")), SCOPE).select(*SCOPE, F.col("cell").cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("doc_id"), F.col("centroid").alias("embedding"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = _best_of_block(left, right, probes, -2.0) if len(right) else pd.DataFrame({"query_id": [], "chunk_id": []})
        first = (left if len(left) else right)[SCOPE].iloc[0]
        return pd.DataFrame({key: best["query_id"], "tenant_id": first["tenant_id"], "kb_id": first["kb_id"], "cell": best["chunk_id"].astype(np.int32)})

    group = [*SCOPE, "block"]
    return dealt.groupBy(*group).cogroup(met.groupBy(*group)).applyInPandas(near, f"{key} long, tenant_id long, kb_id long, cell int")


def _typed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("long").alias(c) for c in SCOPE], F.col("embedding").cast("array<float>").alias("embedding"), *[F.col(c).cast("long").alias(c) for c in rows.columns if c == "doc_id"])


def add_vectors(chunks: DataFrame, path: str) -> None:
    """Append enabled chunks to an index under the centroids that it has. Chunks of scopes that it doesn't know form one
    cell of their scope (0) until it is built anew."""
    spark = chunks.sparkSession
    rows = _typed(chunks.filter("enabled"), "chunk_id")
    parts = spark.read.parquet(f"{path}/layout").first()["parts"]
    cells = _nearest_cells(rows, "chunk_id", spark.read.parquet(f"{path}/centroids"), 1)
    placed = rows.join(cells, ["chunk_id", *SCOPE], "left").withColumn("cell", F.coalesce("cell", F.lit(0)))
    placed = placed.withColumn("part", _part(parts)).repartition("part")
    placed.write.mode("append").partitionBy("part").parquet(f"{path}/cells")


def _part(parts: int):
    return F.pmod(F.xxhash64(*SCOPE, "cell"), F.lit(parts)).cast("int")


def build_index(chunks: DataFrame, path: str, cell_rows: int = 2_000, part_rows: int = 500_000) -> None:
    """Write the index of the enabled chunks (chunk_id, tenant_id, kb_id, doc_id, enabled, embedding) under ``path``:
    ``centroids``, and ``cells`` in about a table partition for each ``part_rows`` vectors (10,000 at most). Zero vectors
    and vectors of a width that is rare in their scope are held like others and score 0. No chunks, an empty index."""
    spark = chunks.sparkSession
    own = _typed(chunks.filter("enabled"), "chunk_id")
    train_centroids(own, cell_rows).write.mode("overwrite").parquet(f"{path}/centroids")
    parts = max(1, min(10_000, -(-own.count() // part_rows)))
    spark.range(1).select(F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{path}/layout")
    spark.createDataFrame([], f"{_SCHEMA}, part int").write.mode("overwrite").partitionBy("part").parquet(f"{path}/cells")
    add_vectors(chunks, path)


_SCHEMA = "chunk_id long, tenant_id long, kb_id long, embedding array<float>, doc_id long, cell int"


def search_index(queries: DataFrame, path: str, top_k: int, min_score: float = 0.0, probes: int | None = 8) -> DataFrame:
    """(query_id, chunk_id, kb_id, doc_id, score, place): what ``block_similarity_join`` gives over the ``probes`` cells
    nearest to each query in its scope (None: over all of them, the exact form). Queries: (query_id, tenant_id, kb_id,
    embedding), one row for each scope. Only table partitions that hold a probed cell are read."""
    spark = queries.sparkSession
    asked = _typed(queries, "query_id")
    centroids = spark.read.parquet(f"{path}/centroids")
    cells = _nearest_cells(asked, "query_id", centroids, MOST_CELLS if probes is None else probes)
    known = asked.join(cells, ["query_id", *SCOPE], "left").withColumn("cell", F.coalesce("cell", F.lit(0)))
    parts = spark.read.parquet(f"{path}/layout").first()["parts"]
    wanted = known.select(_part(parts).alias("part")).distinct()  # a row per table partition at most
    rows = spark.read.schema(f"{_SCHEMA}, part int").parquet(f"{path}/cells").join(F.broadcast(wanted), "part", "left_semi")
    return block_similarity_join(known, rows.withColumn("enabled", F.lit(True)), top_k, min_score, keys=(*SCOPE, "cell"))


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows (query_id, chunk_id) of ``exact`` that ``found`` has; 1.0 where there are none."""
    keys = ["query_id", "chunk_id"]
    hit = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] if exact.limit(1).count() else 1.0


def calibrate_probes(queries: DataFrame, path: str, top_k: int = 10, recall: float = 0.95, most_queries: int = 1_000) -> tuple[int | None, float]:
    """(probes, recall): the least number of the doubling row 1, 2, 4, ... whose recall at ``top_k`` over a bounded sample
    of the queries, against all cells, is at least ``recall``; (None, 1.0) where only all cells give it."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most_queries)
    exact = search_index(sample, path, top_k, -2.0, None).select("query_id", "chunk_id").cache()
    most = queries.sparkSession.read.parquet(f"{path}/centroids").agg(F.coalesce(F.max("cell"), F.lit(0))).first()[0] + 1
    probes = 1
    while probes < most:
        reached = recall_of(search_index(sample, path, top_k, -2.0, probes), exact)
        if reached >= recall:
            exact.unpersist()
            return probes, reached
        probes *= 2
    exact.unpersist()
    return None, 1.0


def index_size(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, kb_id, cells, vectors, largest) of an index."""
    cells = spark.read.parquet(os.path.join(path, "cells")).groupBy(*SCOPE, "cell").agg(F.count("*").alias("n"))
    return cells.groupBy(*SCOPE).agg(F.count("*").alias("cells"), F.sum("n").alias("vectors"), F.max("n").alias("largest"))
