"""Stored indexes: vectors in cells, postings in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import retrieval, vector_index, vectors, word_index

CHUNK = "chunk_id long, tenant_id long, kb_id long, doc_id long, enabled boolean, embedding array<float>"


def near_points(rng, n, centres):
    rows = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.15, (n, centres.shape[1]))
    return [[float(x) for x in r] for r in rows]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (30, 16))
    chunks = [(i, 1, 7, i % 9, i % 11 != 0, v) for i, v in enumerate(near_points(rng, 2400, centres))]
    chunks += [(5000 + i, 2, 8, 0, True, v) for i, v in enumerate(near_points(rng, 20, centres))]
    chunks += [(6000, 1, 7, 0, True, [0.0] * 16), (6001, 1, 7, 0, True, [1.0, 2.0]), (6002, 2, 8, 0, True, [])]
    queries = [(i, 1, 7, v) for i, v in enumerate(near_points(rng, 60, centres))] + [(99, 2, 8, near_points(rng, 1, centres)[0]), (100, 3, 3, [1.0] * 16)]
    return spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(queries, "query_id long, tenant_id long, kb_id long, embedding array<float>")


def found(rows):
    return sorted((r.query_id, r.place, r.chunk_id, round(r.score, 5)) for r in rows.collect())


def test_vector_index(spark, clustered, tmp_path):
    chunks, queries = clustered
    path = str(tmp_path / "index")
    vector_index.build_index(chunks, path, cell_rows=60, part_rows=500)
    exact = vectors.block_similarity_join(queries, chunks, 10, -2.0)
    assert found(vector_index.search_index(queries, path, 10, -2.0, None)) == found(exact)
    few = vector_index.search_index(queries, path, 10, -2.0, 4)
    assert vector_index.recall_of(few, exact) >= 0.9
    probes, recall = vector_index.calibrate_probes(queries, path, 10, 0.95)
    assert probes is not None and probes <= 16 and recall >= 0.95
    sizes = {r.kb_id: (r.cells, r.vectors) for r in vector_index.index_size(spark, path).collect()}
    assert sizes[8] == (1, 21) and 30 <= sizes[7][0] <= 38 and sizes[7][1] == chunks.filter("enabled AND kb_id = 7").count()


def test_added_vectors_are_found(spark, clustered, tmp_path):
    chunks, queries = clustered
    path = str(tmp_path / "index")
    vector_index.build_index(chunks.filter("chunk_id % 4 <> 0"), path, cell_rows=100)
    late = spark.createDataFrame([(9000 + i, 3, 3, 0, True, [1.0] * 15 + [float(i)]) for i in range(5)], CHUNK)
    vector_index.add_vectors(chunks.filter("chunk_id % 4 = 0").unionByName(late), path)
    exact = vectors.block_similarity_join(queries, chunks.unionByName(late), 5, -2.0)
    assert found(vector_index.search_index(queries, path, 5, -2.0, None)) == found(exact)
    assert 100 in {r[0] for r in found(vector_index.search_index(queries, path, 5, -2.0, 1))}


def test_an_empty_vector_index(spark, clustered, tmp_path):
    chunks, queries = clustered
    path = str(tmp_path / "index")
    vector_index.build_index(chunks.limit(0), path)
    assert vector_index.search_index(queries, path, 5).count() == 0
    assert vector_index.search_index(queries.limit(0), path, 5).count() == 0


def words(rng, n):
    return " ".join(f"w{int(x)}" for x in np.minimum(rng.geometric(0.06, n), 60))


def test_word_index_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(word_index, "RANGE", 16)
    rng = np.random.default_rng(2)
    path = str(tmp_path / "words")
    word_index.create_word_index(spark, path)
    now = {}
    queries = spark.createDataFrame([(i, words(rng, 3)) for i in range(12)] + [(50, "absent"), (51, None)], "query_id long, text string")
    scope = queries.select("query_id", F.lit(1).cast("long").alias("tenant_id")).withColumn("kb_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert word_index.search_words(queries, scope, path, 5).count() == 0
    for batch in range(5):
        ids = range(400) if batch == 0 else rng.choice(500, 25, replace=False).tolist()
        rows = [(i, i % 2 + 1 if i % 7 == 0 else 1, "ab"[i % 2], bool(rng.random() < 0.8), words(rng, int(rng.integers(2, 60))) if i % 31 else None) for i in ids]
        now |= {r[0]: r for r in rows}
        schema = "chunk_id long, tenant_id long, kb_id string, enabled boolean, text string"
        word_index.change_chunks(spark.createDataFrame(rows, schema), path)
        if batch in (0, 4):
            want = retrieval.bm25_retrieve(queries, scope, spark.createDataFrame(list(now.values()), schema), 5)
            opened, _ = word_index.open_ranges(queries, scope, path, 5)
            got = word_index.search_words(queries, scope, path, 5)
            assert sorted((r.query_id, r.place, r.chunk_id, round(r.score, 7)) for r in got.collect()) == sorted((r.query_id, r.place, r.chunk_id, round(r.score, 7)) for r in want.collect())
            assert 0 < opened.filter("opened").count() < opened.count()  # blocks are skipped
    levels = word_index._manifest(spark, path)[1]
    assert len(levels) == 2  # the four small ones are one
