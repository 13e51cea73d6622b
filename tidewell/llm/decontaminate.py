"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built once from the items and broadcast (their words are counted first; beyond
``max_words`` the items are dealt into blocks, each with its own automaton and its own pass over the
documents, so that one automaton is held at a time), and every document streams its words through it: the automaton state gives the longest item passage that ends at each word. Words inside
an occurrence of a window (``window`` consecutive item words, or a whole shorter item) are hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import column_bytes, cut_lineage, fold, map_batches, stable_columns, store_rows, unfold

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and blanks every other byte that is no word byte: bytes.split() then yields the words.
TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Words of items in one automaton: by measurement about 800 bytes each in every process that holds it.
MAX_WORDS = 150_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(TO_WORDS).split()


class ItemAutomaton:
    """Suffix automaton over the word numbers of all items, with the items of every window."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = 10):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.windows: dict[tuple[int, ...], list[str]] = {}
        pairs = set()
        for item_id, raw in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words_of(raw)]
            if not ids:
                continue
            last = 0
            for c in ids:
                last = self._extend(last, c)
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1):
                owners = self.windows.setdefault(tuple(ids[i : i + k]), [])
                if item_id not in owners:
                    owners.append(item_id)
            pairs.update(zip(ids, ids[1:]))
        self.lengths = sorted({len(w) for w in self.windows})
        self.pair_bits = np.zeros(1 << 20, bool)
        if pairs:
            a = np.array(sorted(pairs), np.int64)
            self.pair_bits[self._pair(a[:, 0], a[:, 1])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & 0xFFFFF

    def _extend(self, last: int, c: int) -> int:
        go, link, size = self.go, self.link, self.size
        known = go[last].get(c)
        if known is not None:
            if size[known] == size[last] + 1:
                return known
            return self._split(last, c, known)
        new = self._state(size[last] + 1, {})
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = go[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.go[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, size: int, go: dict[int, int]) -> int:
        self.go.append(go)
        self.link.append(-1)
        self.size.append(size)
        return len(self.go) - 1

    def longest(self, ids: list[int]) -> list[int]:
        """For each word, the length of the longest item passage that ends there."""
        go, link, size = self.go, self.link, self.size
        state = length = 0
        out = []
        for c in ids:
            while state and c not in go[state]:
                state = link[state]
                length = size[state]
            state = go[state].get(c, 0)
            length = length + 1 if state else 0
            out.append(length)
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Mask of hit words and the ids of items with an occurring window."""
        hit, found = np.zeros(len(words), bool), set()
        if not self.lengths or not words:
            return hit, found
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        # Only runs of known words whose neighbours stand side by side in some item can hold a window.
        joined = (ids[1:] >= 0) & (ids[:-1] >= 0)
        joined &= self.pair_bits[self._pair(ids[:-1], ids[1:])]
        starts = np.flatnonzero((ids >= 0) & np.r_[True, ~joined])
        ends = np.flatnonzero((ids >= 0) & np.r_[~joined, True]) + 1
        keep = ends - starts >= self.lengths[0]
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist()):
            run = ids[a:b].tolist()
            for i, longest in enumerate(self.longest(run), 1):
                for k in self.lengths:
                    if k > longest:
                        break
                    owners = self.windows.get(tuple(run[i - k : i]))
                    if owners:
                        hit[a + i - k : a + i] = True
                        found.update(owners)
        return hit, found


def _item_rows(items: DataFrame, max_words: int) -> tuple[DataFrame, int]:
    """(block, item_id, text) of the items that have a text, and the number of blocks: about ``max_words`` words
    each, dealt out by hash."""
    text = F.col("text").cast("string")
    rows = stable_columns(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text.alias("text")).filter(F.col("text").isNotNull())
    words = rows.agg(F.coalesce(F.sum(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-words // max_words))
    return rows.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block"), "item_id", "text"), blocks


def _automaton(rows: DataFrame, block: int, window: int) -> ItemAutomaton:
    return ItemAutomaton(((r.item_id, r.text.encode()) for r in rows.filter(F.col("block") == block).toLocalIterator()), window)


def _spans(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of hit words, flat."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edge.tolist()


#: Of a batch's rows: number of words, hit spans, items found.
Marks = tuple[list[int], list[list[int]], list[list[str]]]


def _marks(own: ItemAutomaton, texts: list[bytes]) -> Marks:
    n_words, spans, found = [], [], []
    for raw in texts:
        words = words_of(raw)
        hit, owners = own.hits(words)
        n_words.append(len(words))
        spans.append(_spans(hit))
        found.append(sorted(owners))
    return n_words, spans, found


def _joined(texts: list[bytes], parts: list[list[dict] | None]) -> Marks:
    """Marks of texts from those that every block of items left."""
    n_words, spans, found = [], [], []
    for raw, own in zip(texts, parts):
        n_words.append(len(words_of(raw)))
        hit = np.zeros(n_words[-1], bool)
        for part in own or []:
            for a, b in zip(part["spans"][::2], part["spans"][1::2]):
                hit[a:b] = True
        spans.append(_spans(hit))
        found.append(sorted({x for part in own or [] for x in part["items"]}))
    return n_words, spans, found


def _over(documents: DataFrame, items: DataFrame, window: int, max_words: int, finish: Callable[[pa.RecordBatch, list[bytes], Marks], pa.RecordBatch], schema) -> DataFrame:
    """``finish`` over the batches of ``documents`` and their marks. Items of one block are matched on the way;
    for more, each block is a pass that leaves only what it hit, and these marks are joined to their documents."""
    spark = documents.sparkSession
    rows, blocks = _item_rows(items, max_words)
    if blocks == 1:
        held = spark.sparkContext.broadcast(_automaton(rows, 0, window))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                texts = column_bytes(batch, "text")
                yield finish(batch, texts, _marks(own, texts))

        return map_batches(documents, step, schema)

    names = documents.columns
    docs = cut_lineage(documents.select(F.monotonically_increasing_id().alias("tidewell_uid"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")))
    texts_only = docs.select("tidewell_uid", "row.text")
    passes = []
    for block in range(blocks):
        held = spark.sparkContext.broadcast(_automaton(rows, block, window))

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                _, spans, found = _marks(own, column_bytes(batch, "text"))
                at = [i for i, x in enumerate(spans) if x]
                uid = batch.column("tidewell_uid").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([uid, pa.array([spans[i] for i in at], pa.list_(pa.int32())), pa.array([found[i] for i in at], pa.list_(pa.string()))], ["tidewell_uid", "spans", "items"])

        passes.append(store_rows(map_batches(texts_only, look, "tidewell_uid long, spans array<int>, items array<string>"), "hits"))
        held.destroy()
    hits = reduce(DataFrame.union, passes)
    parts = hits.groupBy("tidewell_uid").agg(F.collect_list(F.struct("spans", "items")).alias("parts"))  # one of each block at most

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(n) for n in names], names)
            texts = column_bytes(own, "text")
            yield finish(own, texts, _joined(texts, batch.column("tidewell_parts").to_pylist()))

    marked = docs.join(parts, "tidewell_uid", "left").select("row.*", F.col("parts").alias("tidewell_parts"))
    return map_batches(marked, join, schema)


def mark_contamination(documents: DataFrame, items: DataFrame, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents' columns plus ``n_words``, ``hit_spans`` (flat word starts and ends) and ``hit_items``.

    Null and empty texts have no words. Repeated rows are marked alike, item ids are compared as strings,
    equal ids count once, null ids as ''. No items: nothing is hit. Documents are read once for each
    ``max_words`` words of items, whose automaton then is the one that driver and workers hold; columns of
    ``documents`` with the names of the marks are replaced.
    """
    marks = ("n_words", "hit_spans", "hit_items")
    base = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in marks])
    names = base.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + ["n_words long", "hit_spans array<int>", "hit_items array<string>"])

    def finish(batch: pa.RecordBatch, texts: list[bytes], own: Marks) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(own, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))]
        return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, *marks])

    return _over(base, items, window, max_words, finish, schema)


def _hit_words(spans: list[int]) -> int:
    return sum(spans[1::2]) - sum(spans[::2])


def contamination_report(documents: DataFrame, items: DataFrame, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document: word counts, hit words, number and digest of the items found in it.

    Nulls, empty texts, repeated rows and items as in ``mark_contamination``; null doc_ids stay null, further
    columns are ignored, an empty table gives no rows. Texts of any length are streamed whole.
    """

    def finish(batch: pa.RecordBatch, texts: list[bytes], own: Marks) -> pa.RecordBatch:
        n_words, spans, found = own
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
        arrays = [pa.array(n_words, pa.int64()), pa.array([_hit_words(x) for x in spans], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(digests, pa.string()), pa.array([bool(x) for x in spans], pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _over(stable_columns(documents, "doc_id", "text"), items, window, max_words, finish, SCHEMA)


def _cut(raw: bytes, spans: list[int]) -> bytes:
    """The text without its hit words; white space around a cut is kept once."""
    places = [m.span() for m in WORD.finditer(raw.translate(LOWER))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at : places[a][0]].rstrip() + b" " if a else b"")
        at = places[b - 1][1]
    out.append(raw[at:].lstrip() if out else raw)
    return b"".join(out)


def remove_contamination(documents: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out of the text, and a document whose hit
    share exceeds ``max_coverage`` goes. Clean documents come out unchanged, null and empty texts among them;
    ``n_chars`` follows the text. Repeated rows are each cut; an empty table stays empty.
    """
    folded = fold(documents)
    rest = folded.schema["rest"].dataType.simpleString()
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def finish(batch: pa.RecordBatch, texts: list[bytes], own: Marks) -> pa.RecordBatch:
        n_words, spans, _ = own
        keep = [i for i, x in enumerate(spans) if _hit_words(x) <= max_coverage * n_words[i]]
        kept = batch.take(pa.array(keep, pa.int64()))
        column, changed = kept.column("text"), [bool(spans[i]) for i in keep]
        if any(changed):
            column = pa.array([_cut(texts[i], spans[i]).decode() if spans[i] else t.as_py() for i, t in zip(keep, column)], pa.string())
        return pa.RecordBatch.from_arrays([kept.column("doc_id"), column, kept.column("rest"), pa.array(changed, pa.bool_())], ["doc_id", "text", "rest", "changed"])

    out = _over(folded, items, window, max_words, finish, f"doc_id {id_type}, text string, rest {rest}, changed boolean")
    return unfold(out, documents.columns, F.col("changed"))
