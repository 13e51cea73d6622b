"""Nothing of a text is lost: captions anywhere in a figure, very long runs before the tokenizer."""

import random

import pytest

from tidewell.llm import media, packing


def shown(html):
    return [(p["pos"], p["kind"], p["text"] or p["ref"], p["caption"]) for p in media.parse_parts(html)]


def test_captions_before_after_and_without_media():
    assert shown('<figure><figcaption>First</figcaption><img src="a"></figure>') == [(0, "media", "a", "First")]
    assert shown('<figure><img src="a" alt="x"><img src="b"><figcaption>Both</figcaption></figure>tail') == [(0, "media", "a", "Both"), (1, "media", "b", "Both"), (2, "text", "tail", None)]
    assert shown("<p>in</p><figure><table><tr><td>1</td></tr></table><figcaption>Table 1</figcaption></figure>out") == [(0, "text", "in", None), (1, "text", "1", None), (2, "text", "Table 1", None), (3, "text", "out", None)]
    assert shown('<figure><figcaption>A</figcaption><img src="a"><figcaption>B<br>C</figcaption></figure>') == [(0, "media", "a", "A B C")]
    assert shown('<figure><figcaption>open <img src="a">end') == [(0, "media", "a", "open end")]
    assert shown('<figure><figcaption>one<figure><figcaption>two</figcaption><img src="a"></figure>') == [(0, "text", "one", None), (1, "media", "a", "two")]
    assert shown("<figcaption>plain</figcaption>") == [(0, "text", "plain", None)] and shown("") == []
    assert len(shown("<div>" * 50_000 + "deep")) == 1


def test_no_character_of_a_page_vanishes():
    own = random.Random(5)
    tags = ["<figure>", "</figure>", "<figcaption>", "</figcaption>", "<p>", "</p>", "<br>", "<b>", "</b>"]
    for _ in range(2000):
        bits = [own.choice(tags) if own.random() < 0.6 else f"w{own.randrange(100)} " for _ in range(own.randrange(1, 25))]
        if own.random() < 0.5:
            bits.insert(own.randrange(len(bits) + 1), '<img src="x">')
        parts = media.parse_parts("".join(bits))
        texts = [p["text"] for p in parts if p["kind"] == "text"] + [c for c in {p["caption"] for p in parts} if c]
        assert sorted("".join(texts).replace(" ", "")) == sorted("".join(b for b in bits if b[0] != "<").replace(" ", ""))
        assert [p["pos"] for p in parts] == list(range(len(parts)))


@pytest.mark.parametrize("run", [" ", "\n", "a", ".", " \n", "é"])
def test_ids_of_very_long_runs(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, plain = packing.Encoder(*packing._default_tokenizer()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for n in (packing.LONG_RUN - 5, packing.LONG_RUN + 5, 2_000_000):
        text = "start " + run * n + "end"
        assert own.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_document_of_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "word")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    by = {d: sum(r.length for r in rows if r.doc_id == d) for d in (1, 2, 3)}
    assert by == {r.doc_id: r.doc_tokens for r in rows} and by[1] > 1_000_000 and by[3] == 2
