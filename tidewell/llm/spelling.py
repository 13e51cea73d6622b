"""Spelling variants of words: PartEnum signatures over the letters of a vocabulary.

Two words one edit apart have letter multisets at a Hamming distance of at most two (an inserted or deleted letter
changes one place of the binary vector, a replaced one two). The alphabet is dealt into parts of about equal weight;
with two changes at most, all parts but two agree, so that each word gets one signature for every pair of parts left
out. An edit also leaves either the first or the last three letters of a word of six and more as they are: they stand in
the signature too, once for each end. Words meet by an equi-join of signatures and are compared letter by letter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import store_rows

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters at either end of a word that a signature holds; twice as many are a word's least length.
EDGE = 3
#: Parts of the alphabet.
PARTS = 6
#: Counts of a chain of forms grow by this factor at least, so that it ends.
FACTOR = 5


def vocabulary(documents: DataFrame, least_length: int = 2 * EDGE, least_count: int = 5, slip: int = 199) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, with at least ``least_length`` letters and
    ``least_count`` occurrences. Where ``slip`` divides the checksum of ``<doc_id>:<run>``, the letter at the
    checksum modulo the length is missing (0: nowhere). Null texts have no words; a null doc_id reads as ''."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if slip:
        at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % slip == 0, less).otherwise(F.col("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _alphabet_parts(words: DataFrame) -> list[str]:
    """The letters of the words in ``PARTS`` strings of about equal weight; a row per letter comes to the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    parts, weights = [""] * PARTS, [0] * PARTS
    for row in sorted(letters, key=lambda r: (-r["count"], r.letter)):
        least = weights.index(min(weights))
        parts[least] += row.letter
        weights[least] += row["count"]
    return parts


def signatures(words: DataFrame) -> DataFrame:
    """(key, side, word, n): for each end of a word and each pair of alphabet parts left out, the number of what is left."""
    parts = _alphabet_parts(words)
    letters = "".join(parts)
    rows = words.withColumn("sorted", F.array_join(F.array_sort(F.split("word", "")), ""))
    for k, own in enumerate(parts):  # the word's letters of that part, in order
        rows = rows.withColumn(f"part{k}", F.translate("sorted", "".join(c for c in letters if c not in own), ""))
    edges = (F.substring("word", 1, EDGE), F.substring("word", -EDGE, EDGE))
    keys = [
        F.struct(F.xxhash64(F.lit(f"{side}.{i}.{j}"), edge, *[f"part{k}" for k in range(PARTS) if k not in (i, j)]).alias("key"), F.lit(side).alias("side"))
        for side, edge in enumerate(edges)
        for i, j in combinations(range(PARTS), 2)
    ]
    return rows.select(F.explode(F.array(*keys)).alias("s"), "word", "n").select("s.key", "s.side", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) once for each ordered pair of words (word, n) that are exactly one edit apart. Words must
    be distinct and have at least six letters, of any alphabet."""
    signed = signatures(words)
    a, b = signed.alias("a"), signed.alias("b")
    first_end = F.substring("a.word", 1, EDGE) == F.substring("b.word", 1, EDGE)
    met = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.side") == F.col("b.side"))
        & (F.col("a.word") < F.col("b.word"))
        & ((F.col("a.side") == 0) | ~first_end)  # a pair that agrees at both ends meets at the first
        & (F.levenshtein("a.word", "b.word", 1) == 1),
    )
    pairs = met.select(F.col("a.word").alias("x"), F.col("a.n").alias("xn"), F.col("b.word").alias("y"), F.col("b.n").alias("yn")).dropDuplicates(["x", "y"])
    both = F.array(F.struct(F.col("x").alias("word"), F.col("xn").alias("n"), F.col("y").alias("near"), F.col("yn").alias("near_n")), F.struct(F.col("y").alias("word"), F.col("yn").alias("n"), F.col("x").alias("near"), F.col("xn").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by joining the chains with themselves; their lengths double.
    Counts grow along a chain, so five steps reach the end of any whose counts fit 64 bits."""
    chains = store_rows(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "chains")
    while chains.filter("moved").limit(1).count():
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = chains.join(on, "root", "left")
        chains = store_rows(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
    return chains.drop("moved")


def spelling_groups(documents: DataFrame, least_length: int = 2 * EDGE, least_count: int = 5, factor: int = FACTOR, slip: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary``.

    ``n_near`` words are exactly one inserted, deleted or replaced code point away. A word's form is the most frequent
    of them (ties: the smallest in code-point order) if it occurs at least ``factor`` times as often; else null. The
    root is where following forms ends: the word itself without a form.

    Null and empty texts give no words, nor does an empty table; texts and runs of any length are read whole; repeated
    rows count again; other columns of ``documents``, whatever their names, take no part.
    """
    if least_length < 2 * EDGE or factor < 2:
        raise ValueError(f"words need {2 * EDGE} letters at least, and a form must be twice as frequent at least")
    words = store_rows(vocabulary(documents, least_length, least_count, slip), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    good = -F.col("best.less") >= factor * F.col("n")
    rows = rows.select("word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, -F.col("best.less")).alias("form_n"))
    rows = store_rows(rows, "forms")
    roots = _roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
