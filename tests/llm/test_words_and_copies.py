"""Collocations, spelling variants and exact duplicates against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidewell.llm import collocations, content_sort, queries, spelling


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- exact duplicates


def same_texts(inputs, change=lambda t: t):
    groups = defaultdict(list)
    for doc, text in inputs:
        groups[change(text or "")].append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for doc, n in Counter(ids).items():
            for k in range(n):
                out.append((doc, keep, len(ids), doc == keep and k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark, odd, odd_rows, odd_wide, nothing, tables):
    assert rows(content_sort.exact_groups(odd)) == same_texts(odd_rows)
    assert rows(content_sort.exact_groups(odd_wide, slot_rows=1)) == same_texts(odd_rows)
    assert content_sort.exact_groups(nothing).count() == 0
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    assert rows(content_sort.exact_groups(tables["documents"], slot_rows=2)) == same_texts(docs)


def test_exact_groups_of_normal_forms(spark):
    inputs = [(1, "A  b\n"), (2, "a b"), (3, "a c"), (4, None), (5, " ")]
    got = content_sort.exact_groups(spark.createDataFrame(inputs, "doc_id long, text string"), content_sort.squeezed)
    assert rows(got) == same_texts(inputs, lambda t: " ".join(t.lower().split()))


def test_a_hot_text_is_dealt_out(spark):
    """A third of all rows is one text, and another third differs from it in the last letter only."""
    long = "the same beginning of every text " * 40
    inputs = [(i, long + "x") for i in range(900)] + [(i, long + "y") for i in range(850, 1600)] + [(i, f"{long}{i}") for i in range(700)]
    docs = spark.createDataFrame(inputs, "doc_id long, text string").repartition(5)
    assert rows(content_sort.exact_groups(docs, slot_rows=50)) == same_texts(inputs)


def test_content_sort_moves_texts_once_without_python(spark, tables):
    plan = content_sort.exact_groups(tables["documents"], slot_rows=10_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan


# --- spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(inputs, least_count, slip=199):
    counts = Counter()
    for doc, text in inputs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_count}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    found = {}
    for w, n in words.items():
        own = [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        found[w] = (best if best and words[best] >= 5 * n else None, len(own))
    out = []
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, form, root, words[w], n_near, words.get(form)))
    return sorted(out, key=repr)


def test_spelling_of_the_table(spark, tables):
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    for least, slip in ((5, 199), (2, 7)):  # more slips, more variants
        want = variants(docs, least, slip)
        assert rows(spelling.spelling_groups(tables["documents"], least_count=least, slip=slip)) == want
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] != w[2] for w in want if w[1])


def test_spelling_of_odd_rows(spark, odd, odd_rows, odd_wide, nothing):
    want = variants(odd_rows, 1)
    assert rows(spelling.spelling_groups(odd, least_count=1)) == want
    assert rows(spelling.spelling_groups(odd_wide, least_count=1)) == want
    assert spelling.spelling_groups(nothing).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(odd, least_length=5)


def test_near_pairs_are_whole(spark):
    """Random words over few letters, where nearly all multisets are alike; edits at every place."""
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abcß"), rng.integers(6, 9))) for _ in range(700)}
    words |= {"abcdefghij"[:k] + c + "abcdefghij"[k + d :] for k in range(11) for c in ("", "x", "é") for d in (0, 1)} - {""}
    frame = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    got = Counter((r.word, r.near) for r in spelling.near_pairs(frame).collect())
    assert got == Counter((a, b) for a in words for b in words if near(a, b))


def test_chains_of_forms(spark):
    counts = [("aaaaaa", 1), ("aaaaab", 5), ("aaaabb", 25), ("aaabbb", 125), ("aabbbb", 625), ("abbbbb", 3125)]
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts)], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_groups(docs, least_count=1, slip=0).collect()}
    assert got["aaaaaa"] == ("aaaaab", "abbbbb") and got["abbbbb"] == (None, "abbbbb") and got["aabbbb"] == ("abbbbb", "abbbbb")


# --- collocations


def phrases(inputs, least, longest, top, percent=50):
    """Rows by lang of (lang, text), counted one by one."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in inputs:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in good.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    cover[p[s : s + k]] = max(cover[p[s : s + k]], a)
        kept = []
        for p, a in good.items():
            if 100 * cover[p] >= percent * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out, key=repr)


def test_collocations_of_the_table(spark, tables):
    docs = [(r.lang, r.text) for r in tables["documents"].collect()]
    for least, longest, sample in ((10, 3, 0.2), (4, 4, 0.05), (3, 2, 0.5)):
        assert rows(collocations.collocations(tables["documents"], least, longest, 50, sample=sample)) == phrases(docs, least, longest, 50)


def test_a_bad_sample_only_costs_passes(spark, tables, monkeypatch):
    docs = tables["documents"].filter("doc_id < 60")
    want = phrases([(r.lang, r.text) for r in docs.collect()], 5, 3, 100)
    passes = []
    counts = collocations.phrase_counts
    monkeypatch.setattr(collocations, "phrase_counts", lambda d, gates, *rest: passes.append(len(gates)) or counts(d, gates, *rest))
    assert rows(collocations.collocations(docs, 5, 3, 100, sample=0.0)) == want and passes[-1] == 3
    passes.clear()
    assert rows(collocations.collocations(docs, 5, 3, 100, sample=1.0)) == want and passes[-1] <= 3
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(collocations, "SLICE", 3000)  # texts are cut, and many slices meet
    assert rows(collocations.collocations(docs, 5, 3, 100)) == want


def test_false_hits_leave_no_phrase_out(spark, tables, monkeypatch):
    made = collocations.gate_of

    def crowded(*args):
        gate = made(*args)
        for bits in gate.bitmaps[1:]:
            bits[:] = 255  # every pair hits, also of words that the gate doesn't propose
        return gate

    monkeypatch.setattr(collocations, "gate_of", crowded)
    docs = tables["documents"].filter("doc_id < 60")
    want = phrases([(r.lang, r.text) for r in docs.collect()], 5, 3, 100)
    assert any(w[2].count(" ") == 2 for w in want)
    for sample in (0.0, 0.2):
        assert rows(collocations.collocations(docs, 5, 3, 100, sample=sample)) == want


def test_collocations_of_odd_rows(spark, odd_wide, nothing):
    from pyspark.sql import functions as F

    langs = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "de").otherwise("en")
    docs = odd_wide.withColumn("lang", langs.cast("string"))
    want = phrases([(r.lang, r.text) for r in docs.collect()], 2, 3, 2000)
    assert rows(collocations.collocations(docs, 2, 3)) == want and {w[0] for w in want} >= {"und", "en"}
    assert collocations.collocations(nothing).count() == 0


def test_texts_are_cut_between_words():
    rng = np.random.default_rng(8)
    for _ in range(300):
        raw = bytes(rng.choice(list(b"ab ,\t\n"), rng.integers(0, 60)))
        parts = list(collocations.cut_text(raw, int(rng.integers(1, 12)), 2))
        assert b"".join(p[old:] for p, old in parts) == raw
        for longest in (1, 3):
            want, got = Counter(), Counter()
            for piece in re.split(rb"[,\n]", raw):
                w = piece.split()
                want.update(tuple(w[i : i + longest]) for i in range(len(w) - longest + 1))
            for part, old in parts:
                at = 0
                for piece in re.split(rb"[,\n]", part):
                    spans = [(at + m.start(), m[0]) for m in re.finditer(rb"[^ \t]+", piece)]
                    got.update(tuple(x for _, x in spans[i : i + longest]) for i in range(len(spans) - longest + 1) if spans[i + longest - 1][0] >= old)
                    at += len(piece) + 1
            assert got == want


def test_blanks_longer_than_a_part_join_words(spark, monkeypatch):
    assert list(collocations.cut_text(b"u a b" + b" " * 9 + b"\tc", 6, 2))[-1] == (b"a b   \tc", 4)
    monkeypatch.setattr(collocations, "SLICE", 16)
    texts = [("en", "one two" + " " * 70 + "three\t" + "\t " * 30 + "four. five")] * 4
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = rows(collocations.collocations(docs, 4, 3))
    assert got == phrases(texts, 4, 3, 2000) and {g[2] for g in got} == {"one two three", "two three four"}


def test_queries_of_words_and_copies_match_their_sql(spark, sf_dir):
    for name in ("op11_collocations", "op13_content_sort"):
        got = queries.QUERIES[name](spark, sf_dir)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want)
