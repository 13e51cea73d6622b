"""Terms next to typographic marks."""

import pytest

from tidewell.llm import toxicity

LEXICON = toxicity.Lexicon({"idiot": 7.0, "scum": 6.0}, {}, frozenset())


@pytest.mark.parametrize("text", ["you \u201cidiot\u201d there", "you idiot\u2014go there", "you\u00a0idiot\u2026 there", "you \u2018idiot\u2019 there"])
def test_marks_are_no_letters(text):
    found = toxicity.Scorer(LEXICON).features(text.replace("\u201c", "\u2018").replace("\u201d", "\u2019"))
    assert found[2] == 7.0 and found[6] > 0


def test_short_term_next_to_a_mark():
    assert toxicity.Scorer(LEXICON).features("such scum\u2026 all")[2] == 6.0


def test_quotation_with_dashes():
    text = "page \u201ca\u201d\u2014b of it all then had the \u201cidiot\u201d\u2014and much later on a \u201cscum\u201d again"
    assert toxicity.Scorer(LEXICON).features(text)[8] == 1


def test_scoring_splits_as_training():
    for text in ("a_b c-d e\u2019f 12x \u00e9t\u00e9\u2026", "plain_ascii it's x1"):
        assert toxicity.words_of(text) == toxicity.WORD.findall(text)
