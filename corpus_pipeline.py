"""A training corpus from raw documents: five stages, each an operator of ``tidewell.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again as the next stage's documents, so that a lost executor
costs one stage at most.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, jaccard_join, packing, quality, suffix_dedup
from tidewell.llm._common import checkpoint_dir, drop_folder, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, one stays."""
    return jaccard_join.keep_one(docs, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand elsewhere too are cut out."""
    return suffix_dedup.remove_repeats(docs, length=200)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents made of them for the most part go."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their token ids, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Models, shingle components, suffix matches and tokenizers are beyond SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole documents table. What stages store on their way is dropped with each, and
    a stage's documents once the next one has written its own; the last folder stays, as the result reads it.

    Rows with null or repeated ids, null, empty and very long texts, ties and columns of any name pass as the
    stages' docstrings say; an empty table gives no rows."""
    at = os.path.join(checkpoint_dir(spark), f"tidewell-pipeline-{os.urandom(8).hex()}")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{at}/{number}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
