"""Empty tables, odd rows and clashing columns through stages and the whole pipeline; bounds that small tables don't reach."""

import os
import shutil
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_exact_operators import removed
from tidewell.llm import decontaminate, jaccard_join, language_id, packing, quality, queries, suffix_dedup


@pytest.fixture()
def folder(sf_dir, tmp_path):
    def of(documents):
        for name in ("labels", "benchmark"):
            shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
        documents.write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return of


def test_stages_of_nothing(tables, nothing):
    for out in (quality.keep_good(nothing, tables["labels"]), jaccard_join.keep_one(nothing), suffix_dedup.remove_repeats(nothing), decontaminate.remove_contamination(nothing, tables["benchmark"])):
        assert out.columns == nothing.columns and out.count() == 0


def test_pipeline_of_nothing(spark, nothing, folder):
    assert corpus_pipeline.run(spark, folder(nothing)).count() == 0


def test_pipeline_of_odd_rows(spark, odd_wide, folder):
    at = folder(odd_wide)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):  # the classifier would reject nearly all of them
        stage(spark, docs, at).write.parquet(f"{at}/out{k}")
        docs = spark.read.parquet(f"{at}/out{k}")
        assert docs.columns == odd_wide.columns or k == 3
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} <= {r.doc_id for r in odd_wide.collect()} and all(len(r.ids) == r.length for r in pieces)
    corpus_pipeline.run(spark, at).count()


def test_pipeline_leaves_only_its_result(spark, folder, tables):
    corpus_pipeline.run(spark, folder(tables["documents"].limit(60))).count()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    left = [x for x in os.listdir(shared) if x.startswith("tidewell-pipeline-")]
    assert all(len(os.listdir(f"{shared}/{x}")) == 1 for x in left)


def test_hot_anchor(spark):
    """A passage in thousands of texts, each with its own ends."""
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    inputs = [(i, "".join(rng.choice(list("klmnop "), 150)) + passage[i % 7 : 390 - i % 5] + "".join(rng.choice(list("klmnop "), 120))) for i in range(1500)]
    docs = spark.createDataFrame(inputs, "doc_id long, text string").repartition(6)
    got = Counter(map(tuple, suffix_dedup.removal_report(docs, hot=300).collect()))
    assert got == removed(inputs)


def test_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 50)
    inputs = [(i, "one two three") for i in range(700)] + [(1000 + i, "word " * (i % 90)) for i in range(300)]
    rows = packing.pack_documents(spark.createDataFrame(inputs, "doc_id long, text string").repartition(5)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in inputs)
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 1024 and len(by) <= sum(by.values()) / 1024 * 1.02 + 2


def test_both_forms_of_the_vocabulary_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, quick = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(*packing._default_tokenizer())
    rng = np.random.default_rng(6)
    pools = ["abcdefghij   \n\t'sSdl", "0123456789.,;:!?-_", "äöüßéèñçœ", "漢字仮名ひらがな", "😀🎉👍‍️", "  　\r\n", "<|endoftext|>", "\x00\x01\x7f́ﬁ"]
    for _ in range(1500):
        text = "".join(str(rng.choice(list(pools[int(rng.integers(len(pools)))]))) * int(rng.integers(1, 4)) for _ in range(int(rng.integers(0, 60))))
        text = text.replace("x", " <|endoftext|>")
        assert quick.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids, text


def test_many_languages(spark):
    rng = np.random.default_rng(9)
    letters = [rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8, replace=False) for _ in range(30)]
    rows = [(i, " ".join("".join(rng.choice(letters[i % 30], 5)) for _ in range(25)), f"l{i % 30:02}") for i in range(3000)]
    found = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()
    assert len(found) > 500 and np.mean([r.lang_pred == f"l{r.doc_id % 30:02}" for r in found]) > 0.95


def test_sql_of_decontamination(spark, sf_dir):
    own = duckdb.connect()
    for t in ("documents", "benchmark"):
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = own.sql(queries.ORACLE_SQL["op9_decontamination"])
    got = queries.op9_decontamination(spark, sf_dir)
    assert found.columns == got.columns and Counter(map(tuple, got.collect())) == Counter(found.fetchall())
