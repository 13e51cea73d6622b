import pytest

CLASHING = "uid long, n long, cls string, v long, key string, size long, shard int, score double, runs string, rest string, hit_spans string, n_words long, quality_score double, y int, text_crc32 long, range int, weight long, kind int, component string"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, repeated rows, ties, a very long text, odd letters."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with gnomes near a frozen river " * 4
    return [
        (1, prose),
        (2, prose),
        (2, prose),
        (None, prose + "end"),
        (None, None),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, "word"),
        (7, "naïve çédille ñandú ÄÖÜ 漢字 😀 <|endoftext|> tail"),
        (8, "la " * 30_000),
        (9, "x" * 5_000),
        (10, "Released under the MIT License."),
        (11, prose.replace("wizards", "lizards", 1)),
        (12, "a\x00b\x00c " * 50),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def odd_wide(odd):
    """The same rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    out = odd.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for field in CLASHING.split(", "):
        name, kind = field.split()
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark", "pages")}
