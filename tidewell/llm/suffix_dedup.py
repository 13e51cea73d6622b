"""Repeated passages by a logarithmic family of suffix arrays over sampled places.

A byte goes when a string of ``length`` bytes around it also starts anywhere else. Places are sampled by
content: of the 64-byte strings inside each window of ``length`` bytes the one with the least hash is its
anchor, so equal windows have equal anchors at equal places.

1. Neighbouring windows with one anchor are one run. If the whole span of a run occurs twice (by 128 bits of
   hash), all its windows repeat. Runs whose anchor occurs once repeat nothing. This settles almost everything.
2. Where an anchor occurs with different spans (the ends of a repeat), the spans' texts are dealt out by anchor.
   There a logarithmic index family takes them in batches: each is sorted into a suffix array of its text,
   merge-scanned against the existing levels for common prefixes of ``length`` bytes, and levels of like size
   merge. Of hot anchors each window is dealt out by its own fingerprint instead.
3. Removed bytes are cut from the texts.

Texts travel only for documents that step 2 or 3 needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import column_bytes, cut_lineage, fold, map_batches, mix64, pack_text, stable_columns, store_rows, text_slices, unfold, unpack_text

LENGTH = 200
ANCHOR = 64
#: Positions that one kernel call numbers (20 bits beside the hash).
CHUNK = 1 << 19
#: Entries of one anchor from which on they are dealt out by their spans, and windows by their own fingerprints.
HOT = 5_000
#: Windows that are sorted into one suffix array, and entries of a level that are compared with it at once.
BATCH_WINDOWS, SCAN = 100_000, 16_384
#: Documents whose numbers may be broadcast (8 bytes each); beyond that they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def suffix_array(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the order of the suffixes at ``starts`` by their first ``length`` bytes, ties by place, and
    their ranks in that order, equal where those bytes are. By doubling: ranks of strings of 8 bytes give ranks of
    16, 32 and so on; two overlapping ones cover ``length``. ``text`` holds ``length`` bytes from every start on."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)
    rank, have = np.unique(words, return_inverse=True)[1], 8

    def joined(rank: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:]
        return rank * (int(rank.max()) + 1) + after

    while 2 * have <= length:
        rank = np.unique(joined(rank, have), return_inverse=True)[1]
        have *= 2
    if have < length:
        rank = joined(rank, length - have)
    own = rank[starts]
    order = np.argsort(own, kind="stable")
    return order, own[order]


class SuffixFamily:
    """A logarithmic family of suffix arrays over texts that come in batches; entries are numbered as they come.

    A batch is sorted into a suffix array and merge-scanned against the levels that are there for common prefixes
    of ``length`` bytes; then it becomes a level, and levels of like size merge."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, sorted places, their numbers
        self.repeats: list[np.ndarray] = []
        self.count = 0

    def _prefixes(self, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        whole = np.ndarray((len(text) - self.length + 1,), f"S{self.length}", np.ascontiguousarray(text), strides=(1,))
        return whole[places]

    def add(self, text: np.ndarray, starts: np.ndarray) -> None:
        """Index the suffixes of ``text`` at ``starts``; note, for them and for older ones, which occur again."""
        if not len(starts):
            return
        order, rank = suffix_array(text, starts, self.length)
        places, number = starts[order], order + self.count
        self.repeats.append(np.zeros(len(starts), bool))
        self.count += len(starts)
        again = np.zeros(len(starts), bool)
        same = rank[1:] == rank[:-1]
        again[1:] |= same
        again[:-1] |= same
        own = self._prefixes(text, places) if self.levels else None
        for old_text, old_places, old_number in self.levels:
            span = np.zeros(len(own) + 1, np.int64)
            for first in range(0, len(old_places), SCAN):
                other = self._prefixes(old_text, old_places[first : first + SCAN])
                low, high = np.searchsorted(own, other, "left"), np.searchsorted(own, other, "right")
                met = high > low
                np.add.at(span, low[met], 1)
                np.add.at(span, high[met], -1)
                self._mark(old_number[first : first + SCAN][met])
            again |= np.cumsum(span[:-1]) > 0
        self._mark(number[again])
        level = (text, places, number)
        while self.levels and len(self.levels[-1][1]) <= 2 * len(level[1]):  # geometric merge
            old_text, old_places, old_number = self.levels.pop()
            both = np.concatenate([old_text, level[0]])
            places, number = np.concatenate([old_places, level[1] + len(old_text)]), np.concatenate([old_number, level[2]])
            order, _ = suffix_array(both, places, self.length)
            level = (both, places[order], number[order])
        self.levels.append(level)

    def _mark(self, number: np.ndarray) -> None:
        starts = np.cumsum([0] + [len(r) for r in self.repeats])
        for k in np.unique(np.searchsorted(starts, number, "right") - 1):
            own = number[(number >= starts[k]) & (number < starts[k + 1])]
            self.repeats[k][own - starts[k]] = True

    def repeated(self) -> np.ndarray:
        return np.concatenate(self.repeats) if self.repeats else np.zeros(0, bool)


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """16-byte keys; zero bytes at the end would be lost, so the last bit is set."""
    out = np.empty((len(high), 2), ">u8")
    out[:, 0], out[:, 1] = high, low | np.uint64(1)
    return out.view("S16").ravel()


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-byte strings, for a size of 8 times a power of two."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    x = np.ndarray((len(data) - 7,), "<u8", padded, strides=(1,)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    have, k = 8, 1
    while have < size:
        x = x[:-have] * _ODD[k] + x[have:]
        x ^= x >> np.uint64(31)
        have, k = 2 * have, k + 1
    return mix64(x)


def window_keys(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """128-bit fingerprints of all windows of ``length`` bytes: two independent sums over all 8-byte words."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    x = np.ndarray((len(data) - 7,), "<u8", padded, strides=(1,)).astype(np.uint64)
    n = len(data) - length + 1
    out = []
    for seed in (1, 2):
        h = mix64(x ^ _ODD[seed])
        have, k = 8, seed
        parts = {8: h}
        while have * 2 <= length:
            h = h[:-have] * _ODD[k % 5] + h[have:]
            h ^= h >> np.uint64(29 + seed)
            have, k = 2 * have, k + 1
            parts[have] = h
        # The largest part from the start and from the end of the window cover it.
        out.append(mix64(h[:n] * _ODD[3] + h[length - have : length - have + n]))
    return _keys(*out)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document number, first window, last window, anchor, anchor hash)."""
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.astype(np.uint64)
    hashes = _grams(data, ANCHOR)
    packed = (hashes & ~np.uint64(0xFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    width = length - ANCHOR + 1
    have = 1
    least = packed
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(doc[: len(least)] == doc[length - 1 :])
    anchor = (least[start] & np.uint64(0xFFFFF)).astype(np.int64)
    if not len(start):
        return start, start, start, start, hashes[:0]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = start[new]
    last = start[np.r_[new[1:], True]]
    anchor = anchor[new]
    return doc[first], first, last, anchor, hashes[anchor]


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document number, first, last window in its document, key) for buffers of any size."""
    if len(data) <= CHUNK:
        pieces = [(0, 0, data, offsets)]
    else:  # one long document: windows are cut into chunks, bytes overlap
        pieces = [(0, a, data[a : a + CHUNK], np.array([0, min(CHUNK, len(data) - a)])) for a in range(0, max(1, len(data) - length + 1), CHUNK - length + 1)]
    for first_doc, shift, part, bounds in pieces:
        doc, first, last, anchor, value = anchor_runs(part, bounds, length)
        raw = memoryview(part.tobytes())
        digest = xxhash.xxh3_64_intdigest
        span = [digest(raw[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), anchor.tolist())]
        low = bounds[doc]
        yield first_doc + doc, first - low + shift, last - low + shift, _keys(value, np.array(span, np.uint64))


ENTRY = "key binary, uid long, first int, last int, m int"
SETTLED = "uid long, first int, last int, kind int, anchor binary"
FULL, ENDS, PARTNER, HOT_ENDS, HOT_PARTNER = 1, 2, 3, 4, 5


def _entries(docs: DataFrame, length: int) -> DataFrame:
    """Suffix entries; runs that a batch holds twice are settled there (m = 0) but for their first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpack_text(batches, 4096):
            uid_all = batch.column("uid").to_numpy()
            held = []
            for at, data, offsets in text_slices(batch, limit=CHUNK):
                for doc, first, last, key in _runs(data, offsets, length):
                    if len(doc):
                        held.append((uid_all[at + doc], first, last, key))
            if not held:
                continue
            uid, first, last, key = (np.concatenate(c) for c in zip(*held))
            _, at, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            lead = np.zeros(len(key), bool)
            lead[at] = True
            m = np.minimum(count[group], 2)
            settled = np.flatnonzero(~lead)
            u, a, b = uid[settled], first[settled], last[settled]
            if len(u):  # neighbours in a document become one
                new = np.ones(len(u), bool)
                new[1:] = (u[1:] != u[:-1]) | (a[1:] != b[:-1] + 1)
                u, a, b = u[new], a[new], b[np.r_[new[1:], True]]
            spread = _keys(mix64(u.astype(np.uint64) * _ODD[1] + a.astype(np.uint64)), a.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[key[lead], spread].tolist(), pa.binary()), pa.array(np.r_[uid[lead], u]), pa.array(np.r_[first[lead], a].astype(np.int32)), pa.array(np.r_[last[lead], b].astype(np.int32)), pa.array(np.r_[m[lead], np.zeros(len(u), np.int64)].astype(np.int32))],
                ["key", "uid", "first", "last", "m"],
            )

    return map_batches(docs.select("uid", "text"), step, ENTRY, 4096)


def _hot_anchors(entries: DataFrame, hot: int) -> DataFrame:
    """(anchor): those with ``hot`` entries or more, or with so many more that they are a million at most."""
    anchors = entries.filter("m > 0").groupBy(F.substring("key", 1, 8).alias("anchor")).count()
    least = max(hot, entries.count() // 1_000_000)
    return store_rows(anchors.filter(F.col("count") >= least).select("anchor", F.lit(True).alias("is_hot")), "anchors")


def _settle(entries: DataFrame, partitions: int, hot: int) -> DataFrame:
    """Per anchor: runs whose span repeats (FULL), and runs of anchors with several spans (ENDS; PARTNER for
    one of each repeated span, which other ends may match in part). Entries of hot anchors are dealt out by anchor
    and span, so that no anchor is one task's work; they count as having several spans."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            key, (uid, first, last, m, is_hot) = batch.column("key"), [batch.column(n).to_numpy(zero_copy_only=False) for n in ("uid", "first", "last", "m", "is_hot")]
            done = m == 0
            if done.any():
                yield _settled(uid[done], first[done], last[done], FULL, np.zeros(int(done.sum()), "S8"))
            if not done.all():
                keys = np.frombuffer(b"".join(key.to_pylist()), "S16")
                held.append(tuple(c[~done] for c in (keys, uid, first, last, m, is_hot)))
        if not held:
            return
        keys, uid, first, last, m, is_hot = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(keys, kind="stable")
        keys, uid, first, last, m, is_hot = (c[order] for c in (keys, uid, first, last, m, is_hot))
        anchor = np.ascontiguousarray(keys).view("S8")[::2]
        new_span = np.r_[True, keys[1:] != keys[:-1]]
        span = np.cumsum(new_span) - 1
        full = np.bincount(span, weights=m)[span] > 1
        group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
        mixed = (np.bincount(group, weights=new_span)[group] > 1) | is_hot
        yield _settled(uid[full], first[full], last[full], FULL, np.zeros(int(full.sum()), "S8"))
        for chosen, kind, hot_kind in ((mixed & ~full, ENDS, HOT_ENDS), (mixed & full & new_span, PARTNER, HOT_PARTNER)):
            yield _settled(uid[chosen], first[chosen], last[chosen], np.where(is_hot[chosen], hot_kind, kind), anchor[chosen])

    anchor = F.substring("key", 1, 8)
    rows = entries.withColumn("anchor", anchor).join(F.broadcast(_hot_anchors(entries, hot)), "anchor", "left")
    rows = rows.select("key", "uid", "first", "last", "m", F.coalesce("is_hot", F.lit(False)).alias("is_hot"))
    return map_batches(rows.repartition(partitions, F.when(F.col("is_hot"), F.col("key")).otherwise(anchor)), step, SETTLED, 1 << 16)


def _settled(uid: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray | int, anchor: np.ndarray) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int32), uid.shape)
    arrays = [pa.array(uid), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(kinds.copy()), pa.array(anchor.tolist(), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["uid", "first", "last", "kind", "anchor"])


SPAN = "key binary, uid long, first int, kind int, span binary"


def _spans(docs: DataFrame, ends: DataFrame, length: int) -> DataFrame:
    """The spans of ENDS and PARTNER runs; of hot anchors each window's fingerprint, dealt out by itself."""
    per_doc = ends.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "kind", "anchor")).alias("runs"))  # bounded by a text's length
    joined = _chosen(docs, ends, "left_semi").join(per_doc, "uid")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpack_text(batches):
            rows = []
            size = 0
            for uid, text, runs in zip(batch.column("uid").to_pylist(), column_bytes(batch, "text"), batch.column("runs")):
                for run in runs.as_py():
                    a, b, kind, anchor = run["first"], run["last"], run["kind"], run["anchor"]
                    span = text[a : b + length]
                    if kind in (HOT_ENDS, HOT_PARTNER):
                        keys = window_keys(np.frombuffer(span, np.uint8), length).tolist()
                        rows += [(key.ljust(16, b"\0"), uid, a + i, kind - 2, None) for i, key in enumerate(keys)]
                        size += 40 * len(keys)
                    else:
                        rows.append((anchor, uid, a, kind, span))
                        size += len(span)
                    if size > 1 << 24:
                        yield _span_batch(rows)
                        rows, size = [], 0
            yield _span_batch(rows)

    return map_batches(joined.select("uid", "text", "runs"), step, SPAN)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "uid", "first", "kind", "span"])


def _match_spans(spans: DataFrame, partitions: int, length: int, batch_windows: int = BATCH_WINDOWS) -> DataFrame:
    """Windows of ENDS runs that occur again among the spans of their anchor. Spans come sorted by anchor, so that
    a family lives no longer than the anchors it indexes; single windows come sorted by fingerprint."""

    def hits(uid: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((first, uid))
        uid, first = uid[order], first[order]
        if len(uid):
            new = np.ones(len(uid), bool)
            new[1:] = (uid[1:] != uid[:-1]) | (first[1:] > first[:-1] + 1)
            yield _settled(uid[new], first[new], first[np.r_[new[1:], True]], FULL, np.zeros(int(new.sum()), "S8"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily(length)
        held: list[tuple[np.ndarray, ...]] = []  # of the family's entries: uid, first, asked
        waiting: list[tuple[bytes, int, int, bool]] = []
        windows = 0
        anchor = single = None  # the last ones seen
        single_row: tuple[int, int] | None = None  # of a window met once so far

        def index() -> None:
            nonlocal windows
            data = np.frombuffer(b"".join(w[0] for w in waiting), np.uint8)
            size = np.array([len(w[0]) for w in waiting])
            count = size - length + 1
            row = np.repeat(np.arange(len(waiting)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            family.add(data, (np.cumsum(size) - size)[row] + place)
            uid, first, asked = (np.array([w[k] for w in waiting]) for k in (1, 2, 3))
            held.append((uid[row], first[row] + place, asked[row]))
            waiting.clear()
            windows = 0

        def conclude() -> Iterator[pa.RecordBatch]:
            nonlocal family
            if held:
                uid, first, asked = (np.concatenate(c) for c in zip(*held))
                found = family.repeated() & asked
                yield from hits(uid[found], first[found])
            held.clear()
            family = SuffixFamily(length)

        for batch in batches:
            again: list[tuple[int, int]] = []
            for key, uid, first, kind, span in zip(*[batch.column(n).to_pylist() for n in ("key", "uid", "first", "kind", "span")]):
                if span is None:
                    if key == single:
                        if single_row is not None and single_row[0] >= 0:
                            again.append(single_row)
                        single_row = None
                        if kind == ENDS:
                            again.append((uid, first))
                    else:
                        single, single_row = key, (uid if kind == ENDS else -1, first)
                    continue
                if windows > batch_windows:
                    index()
                    if key != anchor:
                        yield from conclude()
                anchor = key
                waiting.append((span, uid, first, kind == ENDS))
                windows += len(span) - length + 1
            if again:
                yield from hits(*np.array(again).T)
        if waiting:
            index()
        yield from conclude()

    return map_batches(spans.repartition(partitions, "key").sortWithinPartitions("key"), step, SETTLED, 1 << 16)


def _chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents that (don't) occur in ``rows``, by broadcast numbers where there are few enough."""
    numbers = rows.select("uid").distinct()
    few = numbers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(numbers) if few else numbers, "uid", how)


def _kept(text: bytes, runs: list[dict], length: int) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    out, at, removed, n_spans, end = [], 0, 0, 0, -1
    for a, b in sorted((r["first"], r["last"] + length) for r in runs):
        if a > end:
            out.append(text[at:a] if a > at else b"")
            n_spans += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
        at = end
    out.append(text[at:])
    return b"".join(out), removed, n_spans


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(uid, first, last) runs of windows of ``docs`` (uid, packed text; checkpointed, so that uid is fixed)
    that occur again anywhere in the corpus."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    entries = store_rows(_entries(docs, length), "entries")
    settled = cut_lineage(_settle(entries, max(least, size // 64_000_000 + 1), hot))
    ends = settled.filter(F.col("kind") != FULL)
    n_ends = ends.count()
    found = _match_spans(_spans(docs, ends, length), max(least, n_ends // 20_000 + 1), length)
    return settled.filter(F.col("kind") == FULL).select("uid", "first", "last").union(cut_lineage(found).select("uid", "first", "last"))


def _numbered(documents: DataFrame) -> DataFrame:
    return cut_lineage(pack_text(documents.withColumn("uid", F.monotonically_increasing_id())))


def _with_runs(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """``docs`` with ``runs``, null where nothing repeats; only touched documents are shuffled."""
    runs = cut_lineage(repeated_windows(docs.select("uid", "text"), length, hot))
    per_doc = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # bounded by a text's length
    touched = _chosen(docs, runs, "left_semi").join(per_doc, "uid")
    clean = _chosen(docs, runs, "left_anti").withColumn("runs", F.lit(None).cast("array<struct<first:int,last:int>>"))
    return touched.unionByName(clean)


def removal_report(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``documents``.

    Null text is empty; texts shorter than ``length`` bytes lose nothing. Copies repeat each other, so a
    text that stands twice is removed wherever it is long enough. Matches never cross documents. Repeated
    rows and null ids are reported each; texts of any length are read whole; extra columns are ignored; an empty
    table gives no rows.
    """
    docs = _numbered(stable_columns(documents, "doc_id", "text"))
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpack_text(batches):
            rows = []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), batch.column("runs")):
                kept, removed, n_spans = _kept(text, own.as_py() or [], length)
                rows.append((doc_id, len(text), removed, n_spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_runs(docs, length, hot).select("doc_id", "text", "runs")
    return map_batches(rows, step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _on_letters(text: bytes, runs: list[dict], length: int) -> str:
    """The text without its runs; a letter that a run covers in part stays."""
    cover = np.zeros(len(text) + 1, np.int64)
    for r in runs:
        cover[r["first"]] += 1
        cover[r["last"] + length] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    data = np.frombuffer(text, np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, heads)
    return data[~np.repeat(whole, np.diff(np.r_[heads, len(data)]))].tobytes().decode()


def remove_repeats(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``documents`` without their repeated passages; a text of which nothing but blanks is left goes.
    Texts without repeats come out as they were (null text as empty); ``n_chars`` follows the text. Repeated rows,
    null ids, long texts and empty tables as in ``removal_report``."""
    docs = _numbered(fold(documents))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpack_text(batches):
            keep, texts, changed = [], [], []
            for i, (raw, own) in enumerate(zip(column_bytes(batch, "text"), batch.column("runs"))):
                runs = own.as_py()
                text = _on_letters(raw, runs, length) if runs else raw.decode()
                if runs and not text.strip():
                    continue
                keep.append(i)
                texts.append(text)
                changed.append(bool(runs))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), pa.array(texts, pa.string()), kept.column("rest"), pa.array(changed, pa.bool_())], ["doc_id", "text", "rest", "changed"])

    rest = docs.schema["rest"].dataType.simpleString()
    id_type = documents.schema["doc_id"].dataType.simpleString()
    out = map_batches(_with_runs(docs, length, hot), step, f"doc_id {id_type}, text string, rest {rest}, changed boolean")
    return unfold(out, documents.columns, F.col("changed"))
