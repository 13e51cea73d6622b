"""Phrases whose words keep together: Toivonen's mining of contiguous word runs.

A sample of the documents proposes words and phrases. A pass over all documents then counts, exactly, every phrase whose
two parts (all but its last word, all but its first) were proposed: the proposals and their negative border. What the
border shows to be frequent after all widens the proposals, and a further pass counts what that opens, until no frequent
phrase is left out of the proposals; at most one pass for each phrase length and one more. Proposals travel as bitmaps
of bounded size; a false hit in one only means that one more phrase is counted.

Within a task, words and phrases are numbered, counted and only then written out as strings; Spark adds the counts up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm._common import byte_codes, column_bytes, map_batches, mix64, odd_powers, store_rows

# The marks that end a piece, and the blanks between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text whose phrases a task numbers at once.
SLICE = 2 << 20
#: Bits of a proposal's bitmap: this many for each phrase, up to the limit (8 MB).
BITS_EACH, MOST_BITS = 16, 1 << 26
OUT_ROWS = 1 << 17
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.array([2 if c in BREAKS else 1 if c in BLANKS else 0 for c in range(256)], np.uint8)
_CODES = byte_codes(11)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cut_text(raw: bytes, limit: int, keep: int) -> Iterator[tuple[bytes, int]]:
    """``raw`` in parts of about ``limit`` bytes, cut between words: (part, bytes at its start that repeat up to
    ``keep`` words of the same piece from the parts before, however many blanks lie between)."""
    seps = [bytes([c]) for c in BREAKS + BLANKS]
    new, repeated = 0, b""
    while True:
        end = len(raw)
        if end - new > limit:
            end = max(raw.rfind(s, new, new + limit) for s in seps) + 1
            if end <= new:  # a word of more than the limit
                end = min((at for s in seps if (at := raw.find(s, new + limit)) >= 0), default=len(raw) - 1) + 1
        part = repeated + raw[new:end]
        yield part, len(repeated)
        if end == len(raw):
            return
        piece = part[max(part.rfind(bytes([c])) for c in BREAKS) + 1 :]
        words = piece.rsplit(None, keep)[-keep:] if keep else []  # within a piece only BLANKS are white space
        new, repeated = end, b"".join(w + b" " for w in words)


@dataclass
class Tokens:
    """Words of a text slice, numbered: ``ids`` into ``words``; ``piece`` numbers, and which are new to the slice."""

    words: pa.Array
    hashes: np.ndarray
    ids: np.ndarray
    piece: np.ndarray
    new: np.ndarray


def tokens_of(parts: list[tuple[bytes, int]], seed: int) -> Tokens | None:
    """Words of (text, repeated bytes at its start). Hashes depend on the word and the seed."""
    raw = b"\n".join(p for p, _ in parts).translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    word = kind == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return None
    ends = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=ends[1:])
    flat = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data[word].tobytes())])
    coded = flat.dictionary_encode()
    words = coded.dictionary
    new = np.ones(len(first), bool)
    at = 0
    for part, old in parts:
        if old:
            new[np.searchsorted(first, at) : np.searchsorted(first, at + old)] = False
        at += len(part) + 1
    return Tokens(words, _word_hashes(words, seed), coded.indices.to_numpy().astype(np.int64), np.cumsum(kind == 2)[first], new)


def _word_hashes(words: pa.Array, seed: int) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    values = _CODES[data] * odd_powers(0xD6E8FEB86659FD93, int(lengths.max()))[place]
    return mix64(np.add.reduceat(values, starts) + np.uint64(seed * int(_ODD) % (1 << 64)))


def _joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of the last."""
    return mix64(first * _ODD + last)


def _lang_seed(lang: str) -> int:
    value = 0
    for c in lang.encode():
        value = (value * 257 + c + 1) % (1 << 61)
    return value


@dataclass
class Gate:
    """Proposed phrases of each number of words (1, 2, ...) as bitmaps; ``None`` proposes all."""

    bitmaps: list[np.ndarray | None]

    def holds(self, n_words: int, hashes: np.ndarray) -> np.ndarray:
        bits = self.bitmaps[n_words - 1]
        if bits is None:
            return np.ones(len(hashes), bool)
        out = np.ones(len(hashes), bool)
        for at in bit_places(hashes, len(bits) * 8):
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bit_places(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(n_bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def counted(tokens: Tokens, gates: list[Gate], longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of each number of words that the last gate lets through and none before did; words
    themselves with the first gate only."""
    ids, new, size = tokens.ids, tokens.new, len(tokens.words)
    if len(gates) == 1:
        n = np.bincount(ids[new], minlength=size)
        yield tokens.words.filter(pa.array(n > 0)), n[n > 0]
    grams, hashes, strings = ids, tokens.hashes, tokens.words  # the phrase that starts at each word, -1: none
    reached = [np.ones(size, bool)] * len(gates)  # phrases that each gate's pass counted; false hits add none
    for k in range(2, longest + 1):
        a, b = grams[:-1], grams[1:]
        at = np.flatnonzero((a >= 0) & (b >= 0) & (tokens.piece[:-1] == tokens.piece[1:]) if k == 2 else (a >= 0) & (b >= 0))
        passed = [r & g.holds(k - 1, hashes) for r, g in zip(reached, gates)]
        now = [p[a[at]] & p[b[at]] for p in passed]
        some = np.logical_or.reduce(now)
        at, now = at[some], [x[some] for x in now]
        if not len(at):
            return
        key, where, number = np.unique(a[at] * size + ids[at + k - 1], return_index=True, return_inverse=True)
        head, tail = key // size, key % size
        reached = [x[where] for x in now]
        fresh = reached[-1].copy()
        for x in reached[:-1]:
            fresh &= ~x
        n = np.bincount(number[new[at + k - 1]], minlength=len(key))
        out = np.flatnonzero(fresh & (n > 0))
        if k < longest:
            hashes = _joined(hashes[head], tokens.hashes[tail])
            grams = np.full(len(ids), -1, np.int64)
            grams[at] = number
            every = _written(strings, head, tokens.words, tail)
            if len(out):
                yield every.take(pa.array(out)), n[out]
            strings = every
        elif len(out):
            yield _written(strings, head[out], tokens.words, tail[out]), n[out]


def _written(strings: pa.Array, head: np.ndarray, words: pa.Array, tail: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(strings.take(pa.array(head)), words.take(pa.array(tail)), pa.scalar(" ", pa.large_string()))


def phrase_counts(documents: DataFrame, gates: list[Gate], longest: int, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases that ``counted`` gives with at least ``least`` occurrences in all documents;
    with the first gate also, as the phrase '', the number of words of each language."""
    held = documents.sparkSession.sparkContext.broadcast(gates)
    keep = longest - 1

    def flush(waiting: dict[str, list[tuple[bytes, int]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            tokens = tokens_of(parts, _lang_seed(lang))
            if tokens is None:
                continue
            found = list(counted(tokens, held.value, longest))
            if len(held.value) == 1:
                found.append((pa.array([""], pa.large_string()), np.array([tokens.new.sum()])))
            for phrases, n in found:
                for first in range(0, len(phrases), OUT_ROWS):
                    some = phrases.slice(first, OUT_ROWS).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), some, pa.array(n[first : first + OUT_ROWS].astype(np.int64))], ["lang", "phrase", "n"])
        waiting.clear()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[bytes, int]]] = {}
        size = 0
        for batch in batches:
            for lang, raw in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), column_bytes(batch, "text")):
                for part in cut_text(raw, SLICE, keep):
                    waiting.setdefault(lang, []).append(part)
                    size += len(part[0])
                    if size >= SLICE:
                        yield from flush(waiting)
                        size = 0
        yield from flush(waiting)

    rows = map_batches(documents, step, "lang string, phrase string, n long", rows=256)
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == ""))


def _n_words(phrase: str = "phrase"):
    return F.size(F.split(phrase, " "))


def _with_hash(phrases: DataFrame) -> DataFrame:
    """(n_words, hash) of phrases (lang, phrase)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[tuple[bytes, int]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), column_bytes(batch, "phrase")):
                by_lang.setdefault(lang, []).append((phrase, 0))
            for lang, own in by_lang.items():
                tokens = tokens_of(own, _lang_seed(lang))  # a piece for each phrase
                first = np.searchsorted(tokens.piece, np.arange(len(own)))
                n_words = np.diff(first, append=len(tokens.ids))
                words = tokens.hashes[tokens.ids]
                out = words[first]
                for k in range(1, n_words.max()):
                    longer = n_words > k
                    out[longer] = _joined(out[longer], words[first[longer] + k])
                yield pa.RecordBatch.from_arrays([pa.array(n_words, pa.int32()), pa.array(out.view(np.int64))], ["n_words", "hash"])

    return map_batches(phrases.select("lang", "phrase"), step, "n_words int, hash long", rows=1 << 14)


def gate_of(phrases: DataFrame, longest: int) -> Gate:
    """Bitmaps of phrases (lang, phrase) of up to ``longest`` - 1 words; at most ``MOST_BITS`` a length."""
    hashed = store_rows(_with_hash(phrases.filter(F.col("phrase") != "").filter(_n_words() < longest)), "hashes")
    sizes = {r.n_words: r["count"] for r in hashed.groupBy("n_words").count().collect()}  # a row per length
    bitmaps = []
    for k in range(1, longest):
        n_bits = 1 << 16
        while n_bits < min(BITS_EACH * sizes.get(k, 0), MOST_BITS):
            n_bits *= 2
        bits = np.zeros(n_bits // 8, np.uint8)
        places = F.array(F.col("hash").bitwiseAND(F.lit(n_bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(n_bits - 1)))
        at = hashed.filter(F.col("n_words") == k).select(F.explode(places).alias("at")).select((F.col("at") + 1).alias("at"))
        blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        for row in blocks.collect():  # the bitmap's 4 kB blocks
            first = (row.block - 1) * len(row.bits)
            bits[first : first + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
        bitmaps.append(bits)
    return Gate(bitmaps)


def _left_out(phrases: DataFrame, gate: Gate, longest: int) -> int:
    """How many phrases of up to ``longest`` - 1 words the gate doesn't propose."""
    held = phrases.sparkSession.sparkContext.broadcast(gate)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            out = sum(int((~held.value.holds(k, hashes[n_words == k])).sum()) for k in range(1, longest))
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.int64())], ["n"])

    hashed = _with_hash(phrases.filter(F.col("phrase") != "").filter(_n_words() < longest))
    return map_batches(hashed, step, "n long").agg(F.sum("n")).first()[0] or 0


def frequent_phrases(documents: DataFrame, least: int = 10, longest: int = 3, sample: float = 0.2, slack: float = 0.75, seed: int = 5) -> DataFrame:
    """(lang, phrase, n), exact, of all phrases of up to ``longest`` words with at least ``least`` occurrences, and
    as the phrase '' each language's number of words. ``sample`` of the rows propose, at ``slack`` times the share
    of ``least``; both change the number of passes and never the result. Edge cases: see ``collocations``."""
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    everything = Gate([None] * longest)
    lowered = max(2, round(least * sample * slack))
    proposed = phrase_counts(texts.sample(sample, seed), [everything], max(1, longest - 1), lowered)
    gates = [gate_of(proposed, longest)]
    found = None
    while True:
        more = store_rows(phrase_counts(texts, gates, longest, least), "phrases")
        found = more if found is None else found.unionByName(more)
        if not _left_out(more, gates[-1], longest):
            return found
        gates.append(gate_of(found, longest))


def collocations(documents: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, cover_percent: int = 50, sample: float = 0.2) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z only) and split at sentence marks and line ends into pieces, those at blanks and tabs into
    words. ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut, ``n`` the language's words; score is
    floor(1,000,000 * a * a / (l * r)), of cuts the least, of equal ones the first. A phrase goes if a longer candidate
    holds its words and has at least ``cover_percent`` of its count. Order: score, count (falling), phrase (UTF-8 bytes).
    Counts must stay under 10 ** 15, so that products fit 38 digits.

    A null lang is ``und``; null and empty texts have no words; repeated rows count again; texts, pieces and words of
    any length are read whole; an empty table gives no rows; other columns, whatever their names, take no part.
    """
    found = frequent_phrases(documents, least, longest, sample)
    totals = found.filter(F.col("phrase") == "").select("lang", F.col("n").alias("total"))
    found = found.filter(F.col("phrase") != "")
    candidates = found.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).filter(F.size("w") > 1)
    inner = F.expr("""flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), s -> array_join(slice(w, s, k), ' '))))""")
    covers = candidates.filter(F.size("w") > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    candidates = candidates.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("cover"), F.lit(0)) < cover_percent * F.col("a"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    left = found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr("CAST(1000000 * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) AS DECIMAL(38, 0)) div CAST(CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)) AS DECIMAL(38, 0))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part"))
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
