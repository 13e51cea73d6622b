"""Queries of the corpus operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import collocations, content_sort, decontaminate, jaccard_join, language_id, license_scan, media, packing, quality, sharding, spelling, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=24, law="bytes")
    digest = F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary"))  # of the record in its shard
    return placed.withColumn("text_crc32", digest).drop("record")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(_table(spark, sf_dir, "documents"), length=200)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_table(spark, sf_dir, "documents"), percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents")).drop("ids")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=10, longest=3, top=2000, cover_percent=50)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, factor=5, slip=199)


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_media_columns": op8_media_columns,
    "op10_license_scan": op10_license_scan,
    "op9_decontamination": op9_decontamination,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_content_sort": op13_content_sort,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: Where DuckDB lacks the functions (CRC-32, tokenizers, automata, models) there is none; tests/llm holds those
#: queries against brute force, an exact round trip or held-out accuracy.
ORACLE_SQL = {
    "op9_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        k AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
        x AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM k))),
        h AS (SELECT doc_id, s, n, item_id FROM x JOIN k USING (n, g)),
        p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
        o AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op11_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY 1),
        g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM q, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k) GROUP BY ALL),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND a >= 10),
        o AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS m FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY 1, 2),
        x AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS h FROM c LEFT JOIN o USING (lang, phrase) WHERE coalesce(100 * m, 0) < 50 * a),
        y AS (SELECT x.lang, x.phrase, x.a, h, f.a AS l, b.a AS r, CAST(1000000::HUGEINT * x.a * x.a // (f.a::HUGEINT * b.a) AS BIGINT) AS score
            FROM x JOIN g f ON f.lang = x.lang AND f.phrase = array_to_string(w[1 : h], ' ') JOIN g b ON b.lang = x.lang AND b.phrase = array_to_string(w[h + 1 :], ' ')),
        z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) QUALIFY rank <= 2000""",
    "op13_content_sort": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
