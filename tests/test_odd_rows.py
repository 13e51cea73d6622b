"""Queries against their SQL on small tables with rows that the test tables lack."""

import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tests.test_queries import plain
from tidewell.functions import pages
from tidewell.operators import retrieval, vectors
from tidewell.plans import registry


def both(spark, folder, name, **tables):
    """The rows of a query and those of its SQL over ``tables`` (name -> SELECT), written into ``folder``."""
    own = duckdb.connect()
    for t, text in tables.items():
        own.sql(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    found = own.sql(registry.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    return rows, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_blocks_that_end_in_their_own_number(spark, tmp_path):
    """Trimming took a block's place for the characters to trim."""
    rows, want = both(spark, tmp_path, "chunk_blocks", documents="SELECT 1 AS doc_id, '0 a 10' || chr(10) || ' 1 b 11 ' || chr(10) || '2' AS text")
    assert rows == want


def test_titles_with_cut_references(spark, tmp_path):
    titles = "a &amp</title>", "b &am</title>", "&quot;c&quot; &amp;amp; &lt;d &AMP;</title>", "e &amp;&#65;&amp;</TITLE>"
    rows = ", ".join(f"({k}, '<title>{t}<p>&amp &lt;x</p>')" for k, t in enumerate(titles, 1))
    rows, want = both(spark, tmp_path, "page_outcome", pages=f"SELECT CAST(k AS BIGINT) AS page_id, 'http://a.example/' AS url, h AS html FROM (VALUES {rows}) v(k, h)")
    assert rows == want


def test_reader_takes_cut_references():
    assert pages.page_text("<title>a &amp</title><p>b &lt c") == ("a &", "b < c", False)


def test_copies_tie_in_the_fused_list(spark, monkeypatch):
    """Word scores that differ only by the order in which they were summed go by the smaller chunk id."""
    words = spark.createDataFrame([(0, 8, 82.29039828570095, 2), (0, 7, 82.29039828570092, 1), (0, 9, 12.5, 3)], "query_id long, chunk_id long, score double, place int")
    monkeypatch.setattr(retrieval, "bm25_retrieve", lambda *_, **__: words)
    chunks = spark.createDataFrame([(k, 1, 1, 1, 0, True, "some words") for k in (7, 8, 9)], "chunk_id long, tenant_id long, kb_id long, doc_id long, seq int, enabled boolean, text string")
    queries = spark.createDataFrame([(0, "words")], "query_id long, text string")
    scope = spark.createDataFrame([(0, 1, 1)], "query_id long, tenant_id long, kb_id long")
    none = chunks.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", "kb_id", "doc_id", F.lit(0.0).alias("score")).limit(0)
    hits = retrieval.hybrid_retrieve(queries, scope, chunks, none, 3, 0.05, final_min=0.0).orderBy("place").collect()
    assert [h.chunk_id for h in hits] == [7, 8, 9]


def cancelling(dim):
    """Two words of one bucket whose signs are opposite."""
    seen = {}
    for k in range(10_000):
        h = int.from_bytes(hashlib.blake2b(f"w{k}".encode(), digest_size=8).digest(), "big")
        if other := seen.get((h % dim, 1 - (h >> 63))):
            return f"{other} w{k}"
        seen[h % dim, h >> 63] = f"w{k}"


def test_texts_whose_tokens_cancel_out(spark, tmp_path):
    text = cancelling(64)
    documents = f"SELECT CAST(k AS BIGINT) AS doc_id, t AS text, 'src0' AS source FROM (VALUES (2, '{text}'), (3, '{text} {text}'), (5, '...'), (7, 'a b c')) v(k, t)"
    for name in ("hash_embed", "rebuild_vectors"):
        (tmp_path / name).mkdir()
        rows, want = both(spark, tmp_path / name, name, documents=documents)
        assert rows == want


def test_percentiles_of_windows_with_many_values(spark, tmp_path):
    """Past 10,000 rows a window's percentiles were approximate."""
    events = "SELECT k AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (k % 80000) SECOND AS ts, k % 7 AS user_id, 'view' AS event_type, (k * 7919 % 60013) / 100.0::DOUBLE AS value, '' AS props FROM range(60000) r(k)"
    for name in ("timing_windows", "timing_windows_stream"):
        (tmp_path / name).mkdir()
        rows, want = both(spark, tmp_path / name, name, events=events)
        assert rows == want


def test_upsert_of_numbers_that_are_taken(spark, tmp_path):
    embeddings = "SELECT k AS vec_id, [1.0::FLOAT, k] AS embedding, CAST(k % 10 AS INTEGER) AS label FROM (SELECT unnest([0, 5, 6, 10, 15, 100000, 100005, 100010, 100015]) AS k)"
    rows, want = both(spark, tmp_path, "upsert_vectors", embeddings=embeddings)
    assert rows == want


def test_scores_under_a_half(spark, tmp_path):
    """0.81905 * 10000 lies a little under its half: the score is 0.819, after 0.81907."""
    vectors = ", ".join(f"({k}, [{x}::FLOAT, sqrt(1 - {x} * {x})::FLOAT], 1)" for k, x in ((0, 1.0), (5, 0.81905), (6, 0.81907), (7, 0.5)))
    embeddings = f"SELECT CAST(k AS BIGINT) AS vec_id, e AS embedding, CAST(l AS INTEGER) AS label FROM (VALUES {vectors}) v(k, e, l)"
    rows, want = both(spark, tmp_path, "per_kb_floor", embeddings=embeddings, documents="SELECT CAST(9 AS BIGINT) AS doc_id, 'a' AS text")
    assert rows == want


def test_similarity_join_keeps_its_ties_and_types(spark):
    """Copies of a vector have one score wherever they stand in a block; ids may be strings; a missing vector scores 0."""
    rng = np.random.default_rng(0)
    own = rng.normal(size=(40, 64))
    rows = [(f"c{k:03}", 1, "b", k, True, [float(x) for x in own[k % 40]]) for k in range(400)] + [("none", 1, "b", 1, True, None), ("short", 1, "b", 1, True, [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, tenant_id int, kb_id string, doc_id int, enabled boolean, embedding array<double>")
    queries = spark.createDataFrame([(k, 1, "b", [float(x) for x in own[k]]) for k in range(40)], "query_id int, tenant_id int, kb_id string, embedding array<double>")
    hits = vectors.similarity_join(queries, chunks, 3, -2.0)
    assert dict(hits.dtypes) == {"query_id": "int", "chunk_id": "string", "kb_id": "string", "doc_id": "int", "score": "double", "place": "int"}
    assert {(h.query_id, h.chunk_id, h.place, h.score) for h in hits.collect()} == {(k, f"c{k + 40 * n:03}", n + 1, 1.0) for k in range(40) for n in range(3)}
    least = {h.chunk_id: h.score for h in vectors.similarity_join(queries.limit(1), chunks, 500, -2.0).collect()}
    assert len(least) == 402 and least["none"] == least["short"] == 0.0


def test_similarity_join_makes_no_row_of_every_pair(spark):
    rows = spark.range(1).selectExpr("id AS query_id", "id AS chunk_id", "1 AS tenant_id", "1 AS kb_id", "id AS doc_id", "true AS enabled", "array(1.0D) AS embedding")
    plan = vectors.similarity_join(rows, rows, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "score#" in plan


def test_overview_blocks_are_cut_before_they_meet_the_questions(spark):
    chunks = spark.range(50).selectExpr("id AS chunk_id", "id DIV 50 AS tenant_id", "id % 3 AS kb_id", "50 - id AS doc_id", "0 AS seq", "true AS enabled", "'【文档概览】x' AS text")
    scope = spark.range(2).selectExpr("id AS query_id", "id DIV 50 AS tenant_id").crossJoin(spark.range(3).selectExpr("id AS kb_id"))
    none = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    hits = retrieval.overview_fallback_hits(none, scope, chunks, none)
    assert {(h.query_id, h.chunk_id, h.place) for h in hits.collect()} == {(q, 49 - k, k + 1) for q in range(2) for k in range(4)}
    assert "windowspecdefinition(tenant_id" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_pins_of_questions_with_several_ids(spark):
    """Against brute force: a chunk counts under the first id that it names, and texts meet no window of questions."""
    rng = np.random.default_rng(5)
    ids = [f"{k}{k}{k}45678" for k in range(1, 6)] + ["1114567", "11145678x"]
    texts = [" ".join(rng.choice([*ids, "；", "word"], size=rng.integers(1, 9))) for _ in range(300)]
    asks = [" ".join(rng.choice(ids, size=rng.integers(1, 5))) for _ in range(60)]
    chunks = spark.createDataFrame([(k, 1, k % 2, k, t, k % 7 > 0) for k, t in enumerate(texts)], "chunk_id long, tenant_id long, kb_id long, doc_id long, text string, enabled boolean")
    queries = spark.createDataFrame(list(enumerate(asks)), "query_id long, text string")
    scope = spark.createDataFrame([(q, 1, b) for q in range(60) for b in range(2) if q % 3 != b], "query_id long, tenant_id long, kb_id long")
    hits = retrieval.pin_exact_ids(queries, scope, chunks)
    want = set()
    for q, ask in enumerate(asks):
        tokens = re.findall(retrieval.KEY, ask)[:3]
        found = []
        for k, t in enumerate(texts):
            if k % 7 and q % 3 != k % 2 and (first := next((x for x in tokens if x in t), None)):
                found.append((-t.count(first), -t.count("；"), k))
        want |= {(q, k, n) for n, (_, _, k) in enumerate(sorted(found)[:3], 1)}
    assert {(h.query_id, h.chunk_id, h.place) for h in hits.collect()} == want
    assert "Window" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_counted_in_place(spark):
    own = {1: ["b", "a", "b", "b"], 2: [], 3: ["z"], 4: ["a", "c", "a"]}
    tokens = spark.createDataFrame([(1, 1, k, t) for k, t in own.items()], "tenant_id long, kb_id long, chunk_id long, tokens array<string>")
    rows = retrieval.bm25_postings(tokens)
    assert {(r.chunk_id, r.term, r.tf, r.length) for r in rows.collect()} == {(k, w, t.count(w), len(t)) for k, t in own.items() for w in t}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
