"""Learnt operators: held-out accuracy, odd rows, empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import language_id, license_scan, quality, toxicity


@pytest.fixture(scope="module")
def larger(spark):
    at = "/root/testdata/sf0.01"
    return {n: spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels")}


def accuracy(scored, labels, column):
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    return np.mean([r.predicted == r[column] for r in rows])


def test_quality(larger, odd, odd_rows, odd_wide, nothing):
    model = quality.train(larger["documents"], larger["labels"])
    assert accuracy(quality.score_quality(larger["documents"], larger["labels"], model=model), larger["labels"], "quality") > 0.93
    rows = quality.score_quality(odd, larger["labels"], model=model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score_quality(nothing, larger["labels"]).count() == 0
    kept = quality.keep_good(odd_wide, larger["labels"], model=model)
    assert kept.columns == odd_wide.columns and kept.count() == sum(r.predicted for r in rows)


def test_quality_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}


def test_toxicity(larger, odd, odd_wide, odd_rows, nothing):
    model = toxicity.train(larger["documents"], larger["labels"])
    scored = toxicity.score_toxicity(larger["documents"], larger["labels"], model=model)
    assert accuracy(scored, larger["labels"], "toxic") > 0.93
    for docs in (odd, odd_wide):
        rows = toxicity.score_toxicity(docs, larger["labels"], model=model).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
        assert not any(r.predicted for r in rows)
    assert toxicity.score_toxicity(nothing, larger["labels"], model=model).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automaton_finds_one_edit():
    terms = {"stupid": 3.0, "trash": 2.0, "scum": 5.0}
    own = toxicity.Lexicon(terms, {"réeux": 1.5}, frozenset(["crash"]))
    rng = np.random.default_rng(3)
    words = {"stupid", "trash", "scum", "scam", "crash", "stupidd", "tupid", "trsh", "réeuxabc", "réeux", ""}
    for term in terms:
        for _ in range(300):
            w = list(term)
            for _ in range(int(rng.integers(1, 3))):
                k = int(rng.integers(len(w) + 1))
                kind = rng.integers(3)
                if kind == 0:
                    w.insert(k, rng.choice(list("abst")))
                elif k < len(w):
                    w[k : k + 1] = [] if kind == 1 else [rng.choice(list("abst"))]
            words.add("".join(w))
    for w in words:
        exact = max(terms.get(w, 0.0), 1.5 if w.startswith("réeux") else 0.0)
        fuzzy = max([x for t, x in terms.items() if len(t) >= 5 and distance(w, t) == 1], default=0.0)
        assert own.match(w) == (exact, 0.0 if exact or w == "crash" else fuzzy), w


def test_quotation_is_told_from_abuse():
    own = toxicity.Scorer(toxicity.Lexicon({"idiot": 7.0, "scum": 7.0}, {}, frozenset()))
    plain, quoted = own.features("you idiot and scum"), own.features('the letter said "idiot" and later "scum" again')
    assert plain[1] > quoted[1] and quoted[8] == 1 and plain[8] == 0


def test_language(larger, odd, odd_rows, odd_wide, nothing, spark):
    docs = larger["documents"]
    rows = language_id.identify_languages(docs).join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.own for r in rows]) > 0.98
    model = language_id.train(docs)
    for other in (odd, odd_wide):
        found = language_id.identify_languages(other, model).collect()
        assert Counter(r.doc_id for r in found) == Counter(i for i, _ in odd_rows)
        assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5)} == {"und"}
        assert all(0 <= r.score <= 1 for r in found)
    assert language_id.identify_languages(nothing).count() == 0


def test_codewords_stand_apart():
    code = language_id.codewords(6, 12)
    assert min((code[i] != code[j]).sum() for i in range(6) for j in range(i)) >= 4


def test_licenses(spark, odd, odd_wide, nothing, tables):
    for docs in (odd, odd_wide):
        rows = license_scan.scan_licenses(docs).collect()
        assert [(r.doc_id, r.license, r.exact) for r in rows] == [(10, "MIT-statement", True)]
    text = "Some words first.\nLicensed under the Apache License, Version 2.1.\nother things entirely\n" + license_scan.TEMPLATES["MIT"].replace("free of charge", "for a fee")
    rows = license_scan.scan_licenses(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).orderBy("block").collect()
    assert [(r.license, r.exact, r.n_missing) for r in rows] == [("Apache-2.0-statement", False, 1)] * 2 + [("MIT", False, 3)] * 2
    assert license_scan.scan_licenses(nothing).count() == 0
    exact = license_scan.scan_licenses(tables["documents"]).filter("n_missing = 0").collect()
    lines = [v for k, v in license_scan.TEMPLATES.items() if k.endswith("-statement")]
    want = sum(line in r.text for r in tables["documents"].collect() for line in lines)
    assert len(exact) >= want * 0.9
