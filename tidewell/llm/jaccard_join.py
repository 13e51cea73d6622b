"""N-gram Jaccard join with set-relation skipping.

Documents become sets of word shingles; equal sets are one class. Two classes link when their Jaccard
similarity reaches the threshold. Three ideas keep the exact join near linear:

* answers are derived from similar sets: a class that shares most of its smallest shingles with a leader is
  checked against that leader alone, and afterwards no pair inside a component is looked at again, since
  one verified link has already given its answer;
* only the rarest shingles of a set (its prefix) are indexed. Shingles common in the corpus, counted over
  all documents, come last in the order, so that shared passages hardly enter the index;
* index lists are sorted by set size and skipped in blocks by size and by position: a pair is dropped when
  what is left after the common shingle can't reach the needed overlap. Long lists are cut into blocks of
  classes, and pairs of blocks are compared in tasks of their own.

Pairs that remain are verified on whole texts, so the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidewell.llm._common import byte_codes, column_bytes, cut_lineage, fold, map_batches, mix64, odd_powers, pack_text, stable_columns, store_rows, text_slices, unfold, unpack_text
from tidewell.llm.components import connected_components

N = 5
#: Shingles in the table of common ones: one for so many postings, within these bounds (16 bytes each where it is
#: broadcast).
COMMON_SHARE, COMMON = 500, (50_000, 1_000_000)
#: Postings of one list that are compared in one task; longer lists are cut into blocks, and pairs of blocks dealt out.
BLOCK = 1_500
#: Shingles are counted below this hash: three tenths of the range, where all but a few prefixes end.
LOW = np.uint64(3 * (1 << 64) // 10)
#: Classes whose numbers may be broadcast (8 bytes each); beyond that they are joined by a shuffle.
BROADCAST_CLASSES = 2_000_000
SKETCH = 4
#: Places of a set's parities.
BITS = 1024
#: Percent that a class shares with the leader from whose answers its own are derived, where all links are asked for.
NEAR = 70
#: Differences from their leader in a block of members whose overlaps are derived together (about; a member counts 64 besides).
DIFFERENCES = 50_000
#: Lists of so many open postings first get each posting's nearest neighbour checked.
LARGE = 12
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = odd_powers(0xD6E8FEB86659FD93, N + 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of each lower-cased word."""
    b = _LOWER[data]
    space = _SPACE[b]
    start = ~space
    start[1:] &= space[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    start[firsts] = ~space[firsts]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # From a word's start to the next start: blanks in between count nothing.
    size = np.diff(np.r_[starts, len(b)])
    codes = byte_codes(29)
    codes[_SPACE] = 0
    place = np.arange(starts[0], len(b)) - np.repeat(starts, size)
    width = int(size.max())
    values = codes[b[starts[0] :]] * odd_powers(0x9E3779B97F4A7C15, width)[place]
    return np.searchsorted(offsets, starts, "right") - 1, mix64(np.add.reduceat(values, starts - starts[0]))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash), sorted, each shingle of a document once."""
    doc, word = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    if not len(doc):
        return doc, word
    parts_doc, parts = [], []
    if len(word) >= N:
        mixed = sum((word[j : len(word) - N + 1 + j] * _STEPS[j + 1] for j in range(1, N)), word[: len(word) - N + 1] * _STEPS[1])
        inside = doc[: len(doc) - N + 1] == doc[N - 1 :]
        parts_doc.append(doc[: len(doc) - N + 1][inside])
        parts.append(mix64(mixed[inside]))
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < N))
    if len(short):
        first = np.r_[0, np.cumsum(count)[:-1]]
        own = [int(np.sum(word[first[d] : first[d] + count[d]] * _STEPS[1 : count[d] + 1], dtype=np.uint64)) + int(count[d]) for d in short]
        parts_doc.append(short)
        parts.append(mix64(np.array([x & (2**64 - 1) for x in own], np.uint64)))
    doc, value = np.concatenate(parts_doc), np.concatenate(parts)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _set_of(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return shingle_sets(data, np.array([0, len(data)], np.int64))[1]


def _bits(own: np.ndarray) -> bytes:
    """Parities of a set's shingles over BITS places. Two sets differ in at least as many shingles as their
    parities differ in places, so that most unlike pairs can be dropped without their texts."""
    odd = np.bincount((own >> np.uint64(20)) & np.uint64(BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _classes(documents: DataFrame) -> DataFrame:
    """(doc_id, n, cls, v, sketch, bits, packed text) of every row, checkpointed; all later steps read it.
    ``documents``: (doc_id, text), the text as it is or packed."""
    packed = isinstance(documents.schema["text"].dataType, BinaryType)
    schema = "doc_id long, n long, cls binary, v long, sketch array<long>, bits binary, text binary"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column("text") if packed else pa.array([press(raw) for raw in column_bytes(batch, "text")], pa.binary())
            for first, data, offsets in text_slices(next(unpack_text(iter([batch]), 1 << 30)) if packed else batch):
                rows = len(offsets) - 1
                doc, value = shingle_sets(data, offsets)
                bound = np.searchsorted(doc, np.arange(rows + 1))
                own = [value[bound[i] : bound[i + 1]] for i in range(rows)]
                cls = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in own]
                v = np.array([int.from_bytes(c[:8], "big", signed=True) if c else 0 for c in cls], np.int64)
                sketch = pa.array([x[:SKETCH].view(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, rows), pa.array(np.diff(bound)), pa.array(cls, pa.binary()), pa.array(v), sketch, pa.array([_bits(x) for x in own], pa.binary()), texts.slice(first, rows)],
                    ["doc_id", "n", "cls", "v", "sketch", "bits", "text"],
                )

    return cut_lineage(map_batches(documents.select("doc_id", "text"), step, schema))


def _texts(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, cls, n, text) of the classes that ``pairs`` (v, w; written) names, one row a class."""
    needed = pairs.select("v").union(pairs.select("w"))
    few = 2 * pairs.count() <= BROADCAST_CLASSES
    rows = classes.select("v", "cls", "n", "text").join(F.broadcast(needed) if few else needed.distinct(), "v", "left_semi")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies of a class leave a task once
        for batch in batches:
            keep = []
            for i, c in enumerate(batch.column("cls").to_pylist()):
                if c not in seen:
                    keep.append(i)
                    if len(seen) < 200_000:
                        seen.add(c)
            yield batch.take(pa.array(keep, pa.int64()))

    # Dealt by v alone, so that the aggregate and the joins on either side of a pair share one shuffle.
    return map_batches(rows, once, rows.schema).repartition("v").groupBy("v", "cls", "n").agg(F.first("text").alias("text"))


def _verified(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes among the candidate ``pairs`` (v, w), checked on the whole texts."""
    texts = _texts(classes, pairs)
    one = texts.select("v", F.col("cls").alias("a"), F.col("text").alias("t"))
    two = texts.select(F.col("v").alias("w"), F.col("cls").alias("b"), F.col("text").alias("u"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        open_up = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for i, (b, t, u) in enumerate(zip(batch.column("b").to_pylist(), batch.column("t"), batch.column("u"))):
                if last[0] != b:
                    last = (b, _set_of(open_up(u.as_py())))
                x, y = _set_of(open_up(t.as_py())), last[1]
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    joined = one.join(pairs, "v").join(two, "w").filter(F.col("a") != F.col("b")).select("a", "b", "t", "u")
    return store_rows(map_batches(joined, check, "a binary, b binary"), "links")


def _leaders(classes: DataFrame, percent: int) -> DataFrame:
    """Candidate (v, w): each class and the leader that shares most of its smallest shingles, two at least."""
    keys = classes.select("v", "n", F.explode("sketch").alias("key")).distinct()
    lead = keys.groupBy("key").agg(F.min(F.struct("n", "v")).alias("lead"), F.count("*").alias("m")).filter("m > 1")
    met = keys.join(lead, "key").select("v", "n", F.col("lead.v").alias("w"), F.col("lead.n").alias("wn"))
    met = met.filter((F.col("v") != F.col("w")) & (100 * F.col("wn") >= percent * F.col("n")))
    best = met.groupBy("v", "w").count().groupBy("v").agg(F.max(F.struct("count", "w")).alias("best"))
    return best.filter("best.count > 1").select("v", F.col("best.w").alias("w"))


def _with_components(classes: DataFrame, known: DataFrame) -> DataFrame:
    """(v, comp, text): classes and the component each is known to be in (by itself where none is)."""
    few = known.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    rows = classes.select("v", "text").join(F.broadcast(known) if few else known, "v", "left")
    return rows.select("v", F.coalesce("comp", "v").alias("comp"), "text")


def _common_shingles(rows: DataFrame, postings: float) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted, their rank by count) of those found in most components over all documents.

    Each task counts its documents' shingles, those in the lower part of the hash range that prefixes are
    drawn from, and passes on what two of its components share; the sums are cut to the most common. The table only orders shingles: whatever it holds, the join stays exact.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def shared() -> pa.RecordBatch:
            both = np.concatenate(held)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.r_[True, (both[1:] != both[:-1]).any(1)]]
            value, count = np.unique(both[:, 0], return_counts=True)
            keep = count > 1
            return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep])], ["token", "n"])

        for batch in unpack_text(batches, 2048):
            comp = batch.column("comp").to_numpy().view(np.uint64)
            for first, data, offsets in text_slices(batch):
                doc, value = shingle_sets(data, offsets)
                low = value < LOW
                held.append(np.stack([value[low], comp[first + doc[low]]], 1))
                size += len(held[-1])
                if size > 2_200_000:
                    yield shared()
                    held, size = [], 0
        if size:
            yield shared()

    sums = map_batches(rows, step, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    limit = int(min(max(postings // COMMON_SHARE, COMMON[0]), COMMON[1]))
    top = sums.orderBy(F.desc("n"), "token").limit(limit).toArrow()
    token, count = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, count))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order]


def _index(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """Prefix postings (token, comp, v, n, pos): the first n - ceil(n * percent / 100) + 1 shingles of each
    class, corpus-wide common shingles last."""
    held = rows.sparkSession.sparkContext.broadcast(common)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rank = held.value
        mask = np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[table & mask] = True
        seen: set[int] = set()
        for batch in unpack_text(batches, 2048):
            v_all, comp_all = batch.column("v").to_numpy(), batch.column("comp").to_numpy()
            for first, data, offsets in text_slices(batch):
                rows = len(offsets) - 1
                doc, value = shingle_sets(data, offsets)
                new = np.zeros(rows, bool)
                for i, v in enumerate(v_all[first : first + rows].tolist()):
                    if v not in seen:
                        new[i] = True
                        if len(seen) < 200_000:
                            seen.add(v)
                kept = new[doc]
                doc, value = doc[kept], value[kept]
                if not len(doc):
                    continue
                order_key = np.zeros(len(value), np.int64)
                if len(table):
                    at = np.flatnonzero(maybe[value & mask])
                    spot = np.searchsorted(table, value[at]).clip(max=len(table) - 1)
                    hit = table[spot] == value[at]
                    order_key[at[hit]] = rank[spot[hit]] + 1
                moved = np.lexsort((order_key, doc)) if order_key.any() else np.arange(len(doc))  # stable: by hash within
                doc, value = doc[moved], value[moved]
                n = np.bincount(doc, minlength=rows)
                pos = np.arange(len(doc)) - np.r_[0, np.cumsum(n)[:-1]][doc]
                prefix = n - (n * percent + 99) // 100 + 1
                take = pos < prefix[doc]
                doc = doc[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[take].view(np.int64)), pa.array(comp_all[first + doc]), pa.array(v_all[first + doc]), pa.array(n[doc].astype(np.int32)), pa.array(pos[take].astype(np.int32))],
                    ["token", "comp", "v", "n", "pos"],
                )

    return map_batches(rows, step, "token long, comp long, v long, n int, pos int")


POSTING = "token long, comp long, v long, n int, pos int"
COLUMNS = ["token", "comp", "v", "n", "pos"]


def _open_lists(index: DataFrame) -> DataFrame:
    """(token, blocks) of the lists that hold several components: all answers of the others are known. Counted
    with partial sums, so that no list is gathered for it."""
    lists = index.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"))
    return store_rows(lists.filter("low < high").select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "lists")


def _dealt(postings: DataFrame, lists: DataFrame, partitions: int, *more: str) -> DataFrame:
    """Postings of ``lists`` by pairs of blocks: a list of one block is one group; of a longer one each class belongs
    to a block by hash, and each pair of blocks (x <= y) is a group of its own."""
    few = lists.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    rows = postings.join(F.broadcast(lists) if few else lists, "token").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    rows = rows.select(*COLUMNS, *more, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(*COLUMNS, *more, "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return rows.repartition(partitions, "token", "x", "y")


class _Lists:
    """Postings of one partition in lists, each class once, sorted by set size; ``side`` tells the two blocks of a
    pair apart (-1 where a list is one block). Lists of a single component are left out."""

    def __init__(self, batches: list[pa.RecordBatch]):
        parts = {c: np.concatenate([b.column(c).to_numpy() for b in batches] or [np.zeros(0, np.int64)]) for c in [*COLUMNS, "own", "x", "y"]}
        order = np.lexsort([parts[c] for c in ("v", "n", "y", "x", "token")])
        parts = {c: p[order] for c, p in parts.items()}
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([parts[c][1:] != parts[c][:-1] for c in ("token", "x", "y")])
        once = new.copy()
        once[1:] |= parts["v"][1:] != parts["v"][:-1]
        parts = {c: p[once] for c, p in parts.items()}
        edge = np.flatnonzero(new[once])
        size = np.diff(np.r_[edge, len(parts["v"])])
        keep = np.repeat(np.minimum.reduceat(parts["comp"], edge) != np.maximum.reduceat(parts["comp"], edge), size) if len(edge) else np.zeros(0, bool)
        self.group = np.repeat(np.arange(len(edge)), size)[keep]
        self.token, self.comp, self.v, own, x, y = (parts[c][keep] for c in ("token", "comp", "v", "own", "x", "y"))
        self.n, self.pos = parts["n"][keep].astype(np.int64), parts["pos"][keep].astype(np.int64)
        self.side = np.where(x < y, (own == y).astype(np.int8), np.int8(-1))

    def pairs(self, percent: int, reach: int = 1 << 40) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of pairs in one list and different components that can still reach the needed overlap,
        by their distance in the list. A place whose partner has grown too large is skipped from there on."""
        group, comp, n, pos, side = self.group, self.comp, self.n, self.pos, self.side
        i = np.arange(len(group) - 1)
        step = 1
        while len(i) and step <= reach:
            i = i[i + step < len(group)]
            j = i + step
            near = (group[i] == group[j]) & (n[j] * percent <= n[i] * 100)  # the block of sizes that may link
            i, j = i[near], j[near]
            need = -(-(n[i] + n[j]) * percent // (100 + percent))
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j])  # the common shingle and all after it
            good = (comp[i] != comp[j]) & (rest >= need) & ((side[i] < 0) | (side[i] != side[j]))
            if good.any():
                yield i[good], j[good]
            step += 1

    def record(self, chosen: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(c[chosen]) for c in (self.token, self.comp, self.v, self.n.astype(np.int32), self.pos.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, COLUMNS)


def _open_postings(postings: DataFrame, partitions: int, percent: int, large: int = 0) -> DataFrame:
    """Postings in some pair that component, size and position allow; with ``large`` only of lists of so many
    postings."""
    lists = _open_lists(postings)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Lists([b for b in batches if b.num_rows])
        used = np.zeros(len(own.v), bool)
        for i, j in own.pairs(percent):
            used[i] = True
            used[j] = True
        if large and len(used):
            used &= np.bincount(own.group, weights=used)[own.group] >= large
        if used.any():
            yield own.record(used)

    found = map_batches(_dealt(postings, lists, partitions), step, POSTING, 1 << 16)
    if lists.filter("blocks > 1").limit(1).count():  # those of longer lists come out of several pairs of blocks
        found = found.dropDuplicates(["token", "v"])
    return store_rows(found, "postings")


def _relabelled(postings: DataFrame, known: DataFrame) -> DataFrame:
    """Postings with the components known by now."""
    few = known.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    now = known.withColumnRenamed("comp", "now")
    return postings.join(F.broadcast(now) if few else now, "v", "left").select("token", F.coalesce("now", "v").alias("comp"), "v", "n", "pos")


def _candidates(postings: DataFrame, classes: DataFrame, partitions: int, percent: int, nearest: bool) -> DataFrame:
    """Candidate pairs (v, w) that parities leave over: all of them, or (``nearest``) each posting's most
    similar one among the next in its list, at most one a posting."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        lists = _Lists(kept)
        n, v = lists.n, lists.v
        known = np.concatenate([b.column("v").to_numpy() for b in kept])
        raw = np.frombuffer(b"".join(x for b in kept for x in b.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        known, first = np.unique(known, return_index=True)
        own = first[np.searchsorted(known, v)]
        held: list[np.ndarray] = []
        rows = 0
        best, partner = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
        for i, j in lists.pairs(percent, 32 if nearest else 1 << 40):
            differ = np.bitwise_count(raw[own[i]] ^ raw[own[j]]).sum(1, dtype=np.int64)
            like = differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            i, j, differ = i[like], j[like], differ[like]
            if nearest:
                share = differ / (n[i] + n[j])
                less = share < best[i]
                best[i[less]], partner[i[less]] = share[less], j[less]
            elif len(i):
                held.append(np.unique(np.stack([np.minimum(v[i], v[j]), np.maximum(v[i], v[j])], 1), axis=0))
                rows += len(held[-1])
                if rows > 2_000_000:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    rows = len(held[0])
        if nearest and (found := np.flatnonzero(best < np.inf)).size:
            held = [np.stack([np.minimum(v[found], v[partner[found]]), np.maximum(v[found], v[partner[found]])], 1)]
        if held:
            out = np.unique(np.concatenate(held), axis=0)
            for a in range(0, len(out), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(out[a : a + 200_000, 0].copy()), pa.array(out[a : a + 200_000, 1].copy())], ["v", "w"])

    bits = classes.select("v", "bits").groupBy("v").agg(F.first("bits").alias("bits"))
    with_bits = postings.join(bits, "v").select(*COLUMNS, "bits")
    found = map_batches(_dealt(with_bits, _open_lists(postings), partitions, "bits"), step, "v long, w long", 1 << 16)
    return store_rows(found.distinct(), "pairs")


def link_components(documents: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents``.

    Words are runs of bytes other than blanks, A-Z lower-cased. A text of fewer than five words is one
    shingle; one without words (or null) has none and links with nothing, not even with its like. Equal
    sets are one class and always linked. ``component_id`` is the least non-null doc_id reachable. Repeated
    rows come out repeated; texts of any length are read whole; an empty table gives no rows; extra columns are
    ignored. Classes are numbered by 64 bits of their digest on the way (see the limits in the README).
    """
    return _linked(_documents(documents), percent)


def link_pairs(documents: DataFrame, percent: int = 80, near: int = NEAR) -> DataFrame:
    """(a, b): the digests of every two different classes (see ``class_members``) that link, a < b, each once.

    A class that shares ``near`` percent with a leader is its member, kept as what it has more and less. Members of
    one leader are never searched for each other: the search skips pairs and lists inside a star, and finds for
    pairs of different stars only that these meet. All overlaps inside a star and between stars that meet are then
    derived from their leaders' sets by the differences, without the members' texts. As many rows as there are
    links, which in a group of n near copies may be n * n / 2. Members of one class link with each other besides.
    Texts without words, nulls and empty tables give no rows; repeated rows change nothing.
    """
    classes = _classes(_documents(documents)).filter(F.col("cls").isNotNull())
    stars = _stars(classes, near)
    known = stars.groupBy(_low_long("cls").alias("v")).agg(F.min(_low_long("lead")).alias("comp"))
    total = classes.agg(F.coalesce(F.sum(F.col("n") / 5 + 1), F.lit(0.0))).first()[0]
    partitions = _partitions(classes.sparkSession, total)
    rows = _with_components(classes, known)
    live = _open_postings(_index(rows, _common_shingles(rows, total), percent), partitions, percent)
    pairs = _candidates(live, classes, partitions, percent, False)

    leads = known.select(F.col("comp").alias("lead")).distinct()
    star = known.union(leads.select("lead", "lead")).groupBy("v").agg(F.min("comp").alias("comp"))
    marked = pairs.join(star.withColumnRenamed("comp", "p"), "v", "left").join(star.select(F.col("v").alias("w"), F.col("comp").alias("q")), "w", "left")
    marked = store_rows(marked.select("v", "w", "p", "q"), "marked")
    single = _verified(classes, marked.filter("p IS NULL AND q IS NULL").select("v", "w"), percent)
    met = marked.filter("p IS NOT NULL OR q IS NOT NULL").select(F.coalesce("p", "v").alias("v"), F.coalesce("q", "w").alias("w"))
    met = met.select(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w")).distinct()
    related = store_rows(met.union(leads.select(F.col("lead").alias("v"), F.col("lead").alias("w"))), "related")
    return _ordered(single.union(_derived(classes, stars, related, percent)))


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(classes: DataFrame, near: int) -> DataFrame:
    """(lead, cls, plus, minus): members with what they have more and less than their leader, checked on whole texts.
    A leader is no member itself."""
    pairs = store_rows(_leaders(classes, near), "leaders")
    texts = _texts(classes, pairs)
    one = texts.select("v", F.col("cls").alias("a"), F.col("text").alias("t"))
    two = texts.select(F.col("v").alias("w"), F.col("cls").alias("b"), F.col("text").alias("u"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            keep, plus, minus = [], [], []
            for i, (b, t, u) in enumerate(zip(batch.column("b").to_pylist(), batch.column("t"), batch.column("u"))):
                if last[0] != b:
                    last = (b, _set_of(open_up(u.as_py())))
                x, y = _set_of(open_up(t.as_py())), last[1]
                more, less = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                if 100 * (len(x) - len(more)) >= near * (len(y) + len(more)):
                    keep.append(i)
                    plus.append(more.view(np.int64))
                    minus.append(less.view(np.int64))
            rows = batch.take(pa.array(keep, pa.int64()))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("b"), rows.column("a"), pa.array(plus, kind), pa.array(minus, kind)], ["lead", "cls", "plus", "minus"])

    joined = one.join(pairs, "v").join(two, "w").filter(F.col("a") != F.col("b")).select("a", "b", "t", "u")
    found = store_rows(map_batches(joined, check, "lead binary, cls binary, plus array<long>, minus array<long>").dropDuplicates(["cls"]), "near")
    return store_rows(found.join(found.select(F.col("cls").alias("lead")), "lead", "left_anti"), "stars")


class _Members:
    """A block of members: sizes, and their differences from the leader as (member, shingle, +1 or -1)."""

    def __init__(self, members: list[dict], lead: np.ndarray):
        self.cls = np.array([m["cls"] for m in members], object)
        sides = [(np.array(m[k], np.int64).view(np.uint64), sign) for m in members for k, sign in (("plus", 1), ("minus", -1))]
        size = np.array([len(t) for t, _ in sides])
        self.token = np.concatenate([t for t, _ in sides])
        self.sign = np.repeat(np.array([s for _, s in sides]), size)
        self.member = np.repeat(np.arange(len(sides)) // 2, size)
        self.n = len(lead) + self.sums(np.ones(len(self.token), bool))

    def sums(self, counted: np.ndarray) -> np.ndarray:
        """Of each member, what it has more less what it has less, among the counted differences."""
        return np.bincount(self.member[counted], self.sign[counted], len(self.cls)).astype(np.int64)

    def table(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.cls), len(tokens)), np.float32)
        spot = np.searchsorted(tokens, self.token).clip(max=len(tokens) - 1)
        hit = tokens[spot] == self.token
        out[self.member[hit], spot[hit]] = self.sign[hit]
        return out


def _overlaps(one: _Members, two: _Members, lead_one: np.ndarray, lead_two: np.ndarray, both: int) -> np.ndarray:
    """Overlaps of all members of two blocks, from the overlap of their leaders: what either differs by counts where
    the other leader has it, and differences that both have count by the product of their signs."""
    out = both + one.sums(np.isin(one.token, lead_two))[:, None] + two.sums(np.isin(two.token, lead_one))[None, :]
    shared = np.intersect1d(one.token, two.token)
    for first in range(0, len(shared), 2048):
        tokens = shared[first : first + 2048]
        out += (one.table(tokens) @ two.table(tokens).T).astype(np.int64)  # whole numbers below 2 ** 24: exact
    return out


def _derived(classes: DataFrame, stars: DataFrame, related: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of ``related`` leaders or single classes (v, w; v = w for a leader's own). Members are
    cut into blocks of about DIFFERENCES numbers, and pairs of blocks are dealt out."""
    texts = store_rows(_texts(classes, related), "texts")
    own = texts.select(F.col("cls").alias("lead"), "cls", *(F.lit(None).cast("array<long>").alias(c) for c in ("plus", "minus")))
    empty = F.array().cast("array<long>")
    members = own.union(stars.select("lead", "cls", "plus", "minus")).select("lead", F.struct("cls", F.coalesce("plus", empty).alias("plus"), F.coalesce("minus", empty).alias("minus")).alias("m"))
    weight = F.size("m.plus") + F.size("m.minus") + 64
    counts = members.groupBy("lead").agg(F.ceil(F.sum(weight) / DIFFERENCES).cast("int").alias("blocks"))
    dealt = members.join(counts, "lead").withColumn("block", F.pmod(F.xxhash64("m.cls"), F.col("blocks")).cast("int"))
    blocks = store_rows(dealt.groupBy("lead", "block").agg(F.collect_list("m").alias("members")), "blocks")
    one = texts.select("v", F.col("cls").alias("lead"), F.col("text").alias("t")).join(blocks, "lead").select("v", F.col("lead").alias("a"), "t", F.col("block").alias("x"), F.col("members").alias("ms"))
    two = texts.select(F.col("v").alias("w"), F.col("cls").alias("lead"), F.col("text").alias("u")).join(blocks, "lead").select("w", F.col("lead").alias("b"), "u", F.col("block").alias("y"), F.col("members").alias("ns"))
    same = F.col("a") == F.col("b")
    joined = related.join(one, "v").join(two, "w").filter((F.col("v") != F.col("w")) | (same & (F.col("x") <= F.col("y"))))
    joined = joined.select("t", "u", "ms", "ns", same.alias("same"), (same & (F.col("x") == F.col("y"))).alias("inner"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                x = _set_of(open_up(row["t"]))
                y = x if row["same"] else _set_of(open_up(row["u"]))
                both = len(x) if row["same"] else np.intersect1d(x, y, True).size
                ms, ns = _Members(row["ms"], x), _Members(row["ns"], y)
                met = _overlaps(ms, ns, x, y, both)
                good = 100 * met >= percent * (ms.n[:, None] + ns.n[None, :] - met)
                i, j = np.nonzero(np.triu(good, 1) if row["inner"] else good)
                yield pa.RecordBatch.from_arrays([pa.array(ms.cls[i], pa.binary()), pa.array(ns.cls[j], pa.binary())], ["a", "b"])

    return store_rows(map_batches(joined, step, "a binary, b binary", 16), "derived")


def class_members(documents: DataFrame) -> DataFrame:
    """(doc_id, cls) of every row: the digest of its set of shingles, null for the empty set."""
    return _classes(_documents(documents)).select("doc_id", "cls")


def count_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_links) of every row of ``class_members``: how many other rows it links with, by ``link_pairs``."""
    sizes = members.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.count("*").alias("size"))
    both = links.union(links.select("b", "a")).join(sizes.withColumnRenamed("cls", "b"), "b")
    other = both.groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("others"))
    rows = members.join(sizes.join(other, "cls", "left"), "cls", "left")
    return rows.select("doc_id", F.coalesce(F.col("size") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links"))


def _documents(documents: DataFrame) -> DataFrame:
    return stable_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))


def _partitions(spark: SparkSession, postings: float) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(postings // 2_000_000) + 1)


def keep_one(documents: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents, all columns as they were (null text as empty). Texts without
    words all stay; repeated rows are one group; null ids, long texts and empty tables as in ``link_components``."""
    numbered = cut_lineage(pack_text(fold(documents).withColumn("uid", F.monotonically_increasing_id())))
    groups = _linked(numbered.select(F.col("uid").alias("doc_id"), "text"), percent)
    kept = store_rows(groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("uid")), "kept")
    few = kept.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    rows = numbered.join(F.broadcast(kept) if few else kept, "uid", "left_semi")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpack_text(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.string()), batch.column("rest")], ["doc_id", "text", "rest"])

    rest = numbered.schema["rest"].dataType.simpleString()
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return unfold(map_batches(rows, step, f"doc_id {id_type}, text string, rest {rest}"), documents.columns)


def _known(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the links so far, by class and by class number."""
    found = connected_components(links)
    numbers = found.select(_low_long("vertex").alias("v"), _low_long("component").alias("comp"))
    return found, numbers.groupBy("v").agg(F.min("comp").alias("comp"))


def _linked(documents: DataFrame, percent: int) -> DataFrame:
    stored = _classes(documents)
    classes = stored.filter(F.col("cls").isNotNull())
    total = classes.agg(F.coalesce(F.sum(F.col("n") / 5 + 1), F.lit(0.0))).first()[0]
    partitions = _partitions(documents.sparkSession, total)

    links = _verified(classes, store_rows(_leaders(classes, percent), "leaders"), percent)
    found, known = _known(links)
    rows = _with_components(classes, known)
    live = _open_postings(_index(rows, _common_shingles(rows, total), percent), partitions, percent)
    for nearest in (True, True, False):  # large lists first: most of their pairs then need no look
        now = _open_postings(_relabelled(live, known), partitions, percent, LARGE if nearest else 0)
        pairs = _candidates(now, classes, partitions, percent, nearest) if now.count() else None
        fresh = _verified(classes, pairs, percent) if pairs is not None and pairs.count() else None
        if fresh is not None and fresh.count():
            links = found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(fresh)
            found, known = _known(links)

    found = found.withColumnRenamed("vertex", "cls")
    rows = stored.select("doc_id", "n", "cls").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = store_rows(rows.filter(F.col("cls").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _low_long(column: str) -> Column:
    """The number of a class: the first eight bytes of its digest as a signed long."""
    return F.conv(F.hex(F.substring(F.col(column), 1, 8)), 16, -10).cast("long")
