"""Contexts of word vectors."""

import numpy as np

from tidewell.llm import quality


def test_words_meet_words(spark):
    text = "alpha beta gamma delta"
    sums = quality.context_sums(spark.createDataFrame([(text,)], "text string"))
    data = np.frombuffer(text.encode(), np.uint8)
    _, word, shape = quality.token_stream(data, np.array([0, len(data)]))
    base, want = quality.index_vectors().astype(int), np.zeros(sums.shape)
    for i in range(4):
        for j in range(4):
            if 0 < abs(i - j) <= 2:
                want[word[i]] += base[word[j]] + base[shape[j]]
                want[shape[i]] += base[word[j]]
    assert (sums == want).all()


def test_texts_too_short_for_pairs(spark):
    for texts in (["a", "b"], ["a b", "c d"], ["", "a"]):
        sums = quality.context_sums(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
        assert np.isfinite(sums).all()
