"""Operators with exact contracts against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import components, decontaminate, jaccard_join, media, packing, sharding, suffix_dedup


def bag(df):
    return Counter(map(tuple, df.collect()))


# --- sharding


def check_shards(rows, inputs, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in inputs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return by


def test_shards_bytes(spark, odd, odd_rows, tables, nothing, odd_wide):
    check_shards(sharding.shard_documents(odd).collect(), odd_rows, 24)
    check_shards(sharding.shard_documents(odd_wide, 3).collect(), odd_rows, 3)
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    by = check_shards(sharding.shard_documents(tables["documents"], 5, rows_per_range=20).collect(), docs, 5)
    sizes = [sum(r.size for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) + 8 for _, t in docs)
    assert sharding.shard_documents(nothing).count() == 0


def test_shards_rows_and_hot_key(spark):
    rows = [(7, "same")] * 300 + [(i, "x" * (i % 9)) for i in range(200)]
    by = check_shards(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24, law="rows", rows_per_range=10).collect(), rows, 24)
    counts = [len(own) for own in by.values()]
    assert len(by) == 24 and max(counts) - min(counts) <= 1
    with pytest.raises(ValueError):
        sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), law="none")


# --- suffix dedup


def removed(inputs, length=200):
    count = Counter()
    for _, t in inputs:
        b = (t or "").encode()
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, t in inputs:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                cover[j] += 1
                cover[j + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghéßñ"), 6))
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(int(rng.integers(5, 80))))]
        if i % 2:
            k = int(rng.integers(0, 150))
            parts.append(shared[i % 4][k : k + int(rng.integers(150, 330))])
        if i % 7 == 0:
            parts += [parts[0][:260]] * 2
        out.append((i, " ".join(parts)))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(spark, odd_rows, passages, hot):
    inputs = odd_rows + passages
    got = bag(suffix_dedup.removal_report(spark.createDataFrame(inputs, "doc_id long, text string").repartition(5), hot=hot))
    assert got == removed(inputs)


def test_suffix_dedup_small(nothing, odd_wide, odd_rows):
    assert suffix_dedup.removal_report(nothing).count() == 0
    assert bag(suffix_dedup.removal_report(odd_wide)) == removed(odd_rows)


def test_suffix_dedup_long_document(spark):
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefgh"), 1_300_000))
    inputs = [(1, long), (2, "zz" + long[300_000:300_500] + "yy"), (3, long[-260:])]
    rows = {r.doc_id: r for r in suffix_dedup.removal_report(spark.createDataFrame(inputs, "doc_id long, text string")).collect()}
    assert (rows[1].n_removed, rows[1].n_spans) == (760, 2)
    assert (rows[2].n_removed, rows[3].n_removed) == (500, 260)


def test_suffix_family_levels():
    rng = np.random.default_rng(0)
    length = 20
    family, every = suffix_dedup.SuffixFamily(length), []
    for n in (300, 50, 700, 40, 1200):
        text = np.concatenate([rng.choice([0, 97, 98], 30), np.tile(rng.choice([0, 97, 98], 25), 3), rng.choice([0, 97], n)]).astype(np.uint8)
        starts = np.sort(rng.choice(len(text) - length + 1, n // 2, replace=False))
        family.add(text, starts)
        every += [text[k : k + length].tobytes() for k in starts]
    count = Counter(every)
    assert family.repeated().tolist() == [count[k] > 1 for k in every]
    assert len(family.levels) <= 3
    for text, places, number in family.levels:
        own = [text[k : k + length].tobytes() for k in places]
        assert own == sorted(own) and own == [every[k] for k in number]


def test_batches_of_one_anchor(spark):
    rng = np.random.default_rng(5)
    parts = [rng.choice(list(b"abc"), 40).astype(np.uint8).tobytes() for _ in range(3)]
    texts = [b"".join(parts[k] for k in rng.integers(0, 3, 4)) for _ in range(80)]
    rows = [(b"anchor%d" % (i % 2), i, 10, suffix_dedup.ENDS if i % 5 else suffix_dedup.PARTNER, t) for i, t in enumerate(texts)]
    rows += [(b"%016d" % (i % 3), 1000 + i, i, suffix_dedup.ENDS, None) for i in range(4)]
    spans = spark.createDataFrame(rows, suffix_dedup.SPAN).repartition(3)
    count = Counter((i % 2, t[k : k + 30]) for i, t in enumerate(texts) for k in range(len(t) - 29))
    want = {(i, 10 + k) for i, t in enumerate(texts) if i % 5 for k in range(len(t) - 29) if count[(i % 2, t[k : k + 30])] > 1}
    want |= {(1000, 0), (1003, 3)}
    for batch in (200, 100_000):
        got = suffix_dedup._match_spans(spans, 3, 30, batch).collect()
        assert {(r.uid, k) for r in got for k in range(r.first, r.last + 1)} == want


def test_remove_repeats_keeps_letters(spark, passages, odd_wide):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    before, after = dict(passages), {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()}
    lost = {i: n for (i, _, n, _, _) in removed(passages)}
    for i, text in after.items():
        assert (text == before[i]) == (lost[i] == 0)
        assert len(before[i].encode()) - len(text.encode()) <= lost[i]
    assert suffix_dedup.remove_repeats(odd_wide).columns == odd_wide.columns


# --- Jaccard join

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = BLANKS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(inputs):
    sets = [shingles(t) for _, t in inputs]
    parent = list(range(len(inputs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(inputs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(inputs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(inputs))


@pytest.fixture(scope="module")
def near_copies():
    rng = np.random.default_rng(8)
    word = lambda: "w%d" % rng.integers(0, 5000)
    passage = [word() for _ in range(40)]
    out = []
    for i in range(40):
        base = [word() for _ in range(int(rng.integers(3, 160)))] + (passage if i % 3 == 0 else [])
        for _ in range(int(rng.integers(1, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = word()
            out.append((len(out), " ".join(copy)))
    return out


def test_jaccard_components(spark, odd_rows, near_copies, odd_wide, nothing):
    inputs = odd_rows + [(i + 100, t) for i, t in near_copies]
    assert bag(jaccard_join.link_components(spark.createDataFrame(inputs, "doc_id long, text string").repartition(4))) == components_of(inputs)
    assert bag(jaccard_join.link_components(odd_wide)) == components_of(odd_rows)
    assert jaccard_join.link_components(nothing).count() == 0


def test_hot_shingles_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = np.random.default_rng(12)
    word = lambda: "w%d" % rng.integers(0, 500)
    common = " ".join(word() for _ in range(12))
    inputs = []
    for i in range(60):
        own = [word() for _ in range(int(rng.integers(1, 30)))]
        for _ in range(int(rng.integers(1, 3))):
            inputs.append((len(inputs), f"{common} {' '.join(own)}"))
            own = [*own, word()]
    docs = spark.createDataFrame(inputs, "doc_id long, text string").repartition(3)
    assert bag(jaccard_join.link_components(docs)) == components_of(inputs)
    sets = list({shingles(t) for _, t in inputs})
    links = sum(100 * len(x & y) >= 80 * len(x | y) for k, x in enumerate(sets) for y in sets[:k])
    assert jaccard_join.link_pairs(docs).count() == links


def test_keep_one(spark, near_copies, odd_wide, odd_rows):
    kept = jaccard_join.keep_one(spark.createDataFrame(near_copies, "doc_id long, text string")).collect()
    groups = defaultdict(set)
    for i, _, c in components_of(near_copies):
        groups[c].add(i)
    assert len(kept) == len(groups)
    assert all(len(g & {r.doc_id for r in kept}) == 1 for g in groups.values())
    wide = jaccard_join.keep_one(odd_wide)
    assert wide.columns == odd_wide.columns
    empty = sum(not shingles(t) for _, t in odd_rows)
    assert wide.count() == empty + len({c for i, n, c in components_of([(k, t) for k, (_, t) in enumerate(odd_rows)]) if n})


def test_components_of_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 3)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    by = defaultdict(set)
    for r in got:
        by[r.component].add(r.vertex)
    assert sorted(map(len, by.values())) == [2, 41]


# --- packing


def test_packing(spark, odd, odd_rows, odd_wide, nothing, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs, inputs in ((odd, odd_rows), (odd_wide, odd_rows), (tables["documents"], [(r.doc_id, r.text) for r in tables["documents"].collect()])):
        rows = packing.pack_documents(docs).collect()
        ids = {(i, t): np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in inputs}
        want = Counter()
        for key in inputs:
            x = ids[key]
            want.update((key[0], a, len(x[a : a + 1024]), zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for a in range(0, len(x), 1024))
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(r.length for r in rows)
        assert len(by) <= total / 1024 * 1.05 + 2
    assert packing.pack_documents(nothing).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(2)
    for _ in range(5):
        histogram = np.zeros(129, int)
        for length, n in zip(rng.integers(1, 129, 60), rng.integers(1, 500, 60)):
            histogram[length] += n
        used = np.zeros(129, int)
        for pattern, times in packing.plan_sequences(histogram, 128):
            assert times > 0 and sum(pattern) <= 128
            for part in pattern:
                used[part] += times
        assert (used == histogram).all()


# --- media


def test_media_round_trip(odd, odd_rows, odd_wide, nothing):
    for docs in (odd, odd_wide):
        rows = media.media_digests(docs).collect()
        want = Counter()
        for i, t in odd_rows:
            raw = (t or "").encode()
            payload = raw + bytes(-len(raw) % 64 if raw else 64)
            want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
        for r in rows:
            assert r.pos == 1 and r.caption.startswith("Text of document")
        assert len({(r.media_sha256, r.media_bytes, r.feature) for r in rows}) == len({t or "" for _, t in odd_rows})
    assert media.media_digests(nothing).count() == 0


def test_interleave_keeps_order(spark):
    html = "<h1>Top</h1><p>one<script>no</script></p><figure><img src='media:a' alt='alt'><figcaption>cap &amp; tion</figcaption></figure>two<img src=b><p>three"
    parts = media.interleave(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    got = [(p.kind, p.text or p.ref, p.caption) for p in parts[0].parts]
    assert got == [("text", "Top", None), ("text", "one", None), ("media", "media:a", "cap & tion"), ("text", "two", None), ("media", "b", None), ("text", "three", None)]
    assert parts[1].parts == []
    with pytest.raises(ValueError):
        media.decode_samples(b"not an image")


def test_captions_belong_to_their_figure(spark):
    html = "<img src=media:a alt=A><p>x</p><img src=media:b alt=B><figcaption>loose</figcaption><figure><img src=media:c><img src=media:d><figcaption>both</figcaption></figure><figure><img src=media:e alt=E><figcaption>never closed"
    parts = media.parse_parts(html)
    got = [(p["kind"], p["text"] or p["ref"], p["caption"]) for p in parts]
    assert got == [("media", "media:a", "A"), ("text", "x", None), ("media", "media:b", "B"), ("text", "loose", None), ("media", "media:c", "both"), ("media", "media:d", "both"), ("media", "media:e", "never closed")]


def test_sequences_are_resolved_in_place(spark, tables, odd_rows):
    texts = [t for _, t in odd_rows if t]
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    pages = [(r.page_id, (r.html or "") + "".join(f"<p>before {k}</p><figure><img src='media:{digest[(r.page_id + k) % len(texts)]}'><figcaption>c{k}</figcaption></figure>" for k in range(3)) + "<img src='media:unknown'>") for r in tables["pages"].collect()] + [(-1, None)]
    sequences = media.interleave(spark.createDataFrame(pages, "page_id long, html string"))
    features = media.read_media(media.store_media(spark.createDataFrame([(t,) for t in texts], "text string")))
    rows = {r.page_id: r.parts for r in media.resolve_sequences(sequences, features).collect()}
    by_digest = {d: len(t.encode()) for d, t in zip(digest, texts)}
    assert set(rows) == {i for i, _ in pages} and rows[-1] == []
    for page_id, html in pages[:-1]:
        want = media.parse_parts(html)
        assert [(p.pos, p.kind, p.text, p.ref, p.caption) for p in rows[page_id]] == [tuple(w.values()) for w in want]
        for p in rows[page_id]:
            n = by_digest.get((p.ref or "").removeprefix("media:"))
            assert (p.payload.n_bytes if p.payload else None) == n


def test_interleave_pages(tables):
    rows = media.interleave(tables["pages"]).collect()
    assert all([p.pos for p in r.parts] == list(range(len(r.parts))) for r in rows)


# --- decontamination


def report(inputs, items, window=10):
    tests = [(str(i), decontaminate.words_of((t or "").encode())) for i, t in items]
    owners = defaultdict(set)
    for i, w in tests:
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            owners[tuple(w[j : j + k])].add(i)
    out = Counter()
    for i, t in inputs:
        w = decontaminate.words_of((t or "").encode())
        hit, found = set(), set()
        for k in {len(x) for x in owners}:
            for j in range(len(w) - k + 1):
                if own := owners.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= own
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_decontamination(spark, odd, odd_rows, odd_wide, nothing, tables):
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    assert bag(decontaminate.contamination_report(tables["documents"], tables["benchmark"])) == report(docs, items)
    own = [(1, "the quick brown fox jumps over the lazy dog while seven wizards quietly"), (2, "word"), (3, None), (4, "MIT license"), (2, "la la la la la la la la la la la")]
    few = spark.createDataFrame(own, "item_id long, text string")
    assert bag(decontaminate.contamination_report(odd, few)) == report(odd_rows, own)
    assert bag(decontaminate.contamination_report(odd_wide, few)) == report(odd_rows, own)
    assert decontaminate.contamination_report(nothing, few).count() == 0
    assert not decontaminate.contamination_report(odd, few.limit(0)).filter("contaminated").count()


def test_many_automata_give_the_same(spark, tables):
    whole = decontaminate.mark_contamination(tables["documents"].select("doc_id", "text"), tables["benchmark"])
    parts = decontaminate.mark_contamination(tables["documents"].select("doc_id", "text"), tables["benchmark"], max_words=200)
    assert {r.doc_id: (r.hit_spans, r.hit_items) for r in whole.collect()} == {r.doc_id: (r.hit_spans, r.hit_items) for r in parts.collect()}


def test_remove_contamination(spark, tables, odd_wide):
    docs, items = tables["documents"], tables["benchmark"]
    clean = decontaminate.remove_contamination(docs, items)
    assert clean.columns == docs.columns
    assert not decontaminate.contamination_report(clean, items).filter("contaminated").count()
    before = {r.doc_id: r.text for r in docs.collect()}
    dirty = {r.doc_id for r in decontaminate.contamination_report(docs, items).filter("contaminated").collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert all(after[i].text == t for i, t in before.items() if i not in dirty)
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert decontaminate.remove_contamination(odd_wide, items).columns == odd_wide.columns
