"""Links of the Jaccard join against brute force."""

from collections import Counter

import numpy as np
import pytest

from tests.llm.test_exact_operators import near_copies, shingles  # noqa: F401
from tidewell.llm import jaccard_join


@pytest.mark.parametrize("percent", [80, 60])
def test_all_links(spark, near_copies, odd_rows, percent):  # noqa: F811
    inputs = [(i + 100, t) for i, t in near_copies] + odd_rows
    docs = spark.createDataFrame(inputs, "doc_id long, text string").repartition(3)
    sets = [shingles(t) for _, t in inputs]

    def linked(x, y):
        both = len(x & y)
        return both and 100 * both >= percent * (len(x) + len(y) - both)

    members = jaccard_join.class_members(docs)
    links = jaccard_join.link_pairs(docs, percent).cache()
    got = Counter(map(tuple, jaccard_join.count_links(members, links).collect()))
    assert got == Counter((i, sum(bool(linked(sets[k], sets[m])) for m in range(len(inputs)) if m != k)) for k, (i, _) in enumerate(inputs))
    different = list(set(sets))
    assert links.count() == links.distinct().count() == sum(bool(linked(x, y)) for k, x in enumerate(different) for y in different[:k])


def _incidence(sets):
    place = {t: k for k, t in enumerate(sorted(set().union(*sets)))}
    out = np.zeros((len(sets), len(place)), np.float32)
    for k, own in enumerate(sets):
        out[k, [place[t] for t in own]] = 1
    return out


def _links(sets, percent):
    table = _incidence(sets)
    both = (table @ table.T).astype(np.int64)
    size = np.diag(both)
    return int(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1).sum())


def test_answers_derived_in_a_large_group(spark, monkeypatch):
    """2,000 near copies of two related texts, over several blocks, beside texts of their own: every link, though few
    pairs are searched or have their texts opened."""
    rng = np.random.default_rng(21)
    word = lambda: "w%d" % rng.integers(0, 3000)
    base = [word() for _ in range(300)]
    other = [*base[:270], *(word() for _ in range(30))]
    texts = []
    for i in range(2000):
        own = list(base if i % 4 else other)
        for _ in range(int(rng.integers(0, 8)) if i % 10 else 14):
            own[int(rng.integers(len(own)))] = word()
        texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    opened = []
    verified = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda classes, pairs, percent: opened.append(pairs.count()) or verified(classes, pairs, percent))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    sets = list({shingles(t) for t in texts})
    links = jaccard_join.link_pairs(docs).cache()
    want = _links(sets, 80)
    assert links.count() == links.distinct().count() == want > 250_000
    assert sum(opened) < len(sets)


@pytest.mark.parametrize("near", [95, 50])
def test_derived_overlaps_of_any_block(spark, monkeypatch, near_copies, near):  # noqa: F811
    monkeypatch.setattr(jaccard_join, "DIFFERENCES", 150)
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(3)
    sets = list({shingles(t) for _, t in near_copies})
    assert jaccard_join.link_pairs(docs, 70, near).count() == _links(sets, 70)


def test_links_of_nothing(spark, nothing):
    assert jaccard_join.link_pairs(nothing).count() == 0
