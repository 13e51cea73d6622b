"""Sequence packing by non-negative least squares over the length histogram.

Documents are tokenized once and cut into full windows and one shorter piece; the pieces are stored with
their ids (compressed) and moved once, to the task that ranks their length. The histogram of piece lengths has as many bins as a window has tokens,
whatever the corpus: on it, shallow combinations of lengths that fill a window get repeat counts by
non-negative least squares; rounded counts that the histogram can't cover are lowered and what remains is
packed greedily. Pieces then take their places by rank within their length, with no search over pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import map_batches, stable_columns, store_rows

WINDOW = 1024
PIECES = "doc_id long, start long, length int, packed_ids binary, doc_tokens long"
#: Pieces of an Arrow batch, which carries their ids.
BATCH_PIECES = 2048
#: Pieces of one length that are ranked together; lengths of more are dealt into buckets.
BUCKET_PIECES = 20_000
#: Buckets in all, beyond one for each length: where the corpus would need more, they grow instead.
MOST_BUCKETS = 200_000


#: Characters of a run (of blanks or of others) from which on a text is encoded from the JSON form.
LONG_RUN = 20_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


class Encoder:
    """Ids of the byte-level BPE vocabulary file, end-of-text marker in a text included.

    The rank form of the same vocabulary is read and encoded several times faster than the JSON form; a
    test holds the two equal. Texts with a very long run, on which the rank form's pattern overflows its stack,
    take the JSON form.
    """

    def __init__(self, ranks_path: str, pattern: str, json_path: str, end_of_text: int = 50256):
        import tiktoken

        self._json_path, self._json = json_path, None

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end_of_text})

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and _LONG_RUN.search(text):
            if self._json is None:
                from tokenizers import Tokenizer

                self._json = Tokenizer.from_file(self._json_path)
            return np.asarray(self._json.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if "<|endoftext|>" in text:
            return np.asarray(self._own.encode(text, allowed_special="all"), dtype="<u4")
        return np.asarray(self._own.encode_ordinary(text), dtype="<u4")


def _default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(documents: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of at most ``window`` ids: each document's ids and ``end_id``, cut at multiples of ``window``.
    ``packed_ids`` are the piece's ids as little-endian 32-bit numbers in a Zstandard frame."""
    vocabulary = tokenizer or _default_tokenizer()
    names = ["doc_id", "start", "length", "packed_ids", "doc_tokens"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = Encoder(*vocabulary), zstandard.ZstdCompressor(level=1)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        out: list[tuple] = []
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for doc_id, text in zip(doc_ids, texts):
                ids = np.append(own.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    out.append((doc_id, start, len(part), press.compress(part.tobytes()), len(ids)))
                    if len(out) == BATCH_PIECES:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return map_batches(stable_columns(documents, "doc_id", "text"), step, PIECES)


def combinations(lengths: list[int], window: int, step: int = 16) -> list[tuple[int, ...]]:
    """Combinations of at most three of the given lengths that fill the window; in triples the shortest
    part is every ``step``-th length."""
    there = set(lengths)
    out: list[tuple[int, ...]] = [(window,)] if window in there else []
    out += [(window - a, a) for a in lengths if a <= window - a and window - a in there]
    for a in lengths[::step]:
        out += [(window - a - b, b, a) for b in lengths if a <= b <= window - a - b and window - a - b in there]
    return out


def solve_repeats(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares for the repeat counts: min |A x - histogram|, x >= 0, by accelerated
    projected gradient; A has a column per combination and is kept as index lists."""
    if not combos:
        return np.zeros(0)
    at = np.concatenate([[k] * len(c) for k, c in enumerate(combos)]).astype(np.int64)
    bins = np.concatenate([np.array(c) for c in combos]).astype(np.int64)
    n_bins = len(histogram)
    # Weighted so that a step suits each bin: bins in many combinations get smaller moves.
    uses = np.maximum(np.bincount(bins, minlength=n_bins), 1)
    step = 1.0 / (3.0 * np.maximum.reduceat(uses[bins], np.r_[0, np.cumsum([len(c) for c in combos])[:-1]]))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        miss = np.bincount(bins, weights=y[at], minlength=n_bins) - histogram
        new = np.maximum(0.0, y - step * np.bincount(at, weights=miss[bins], minlength=len(combos)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def plan_sequences(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, times) that use every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan.append((pattern, times))
            for part in pattern:
                left[part] -= times

    def fits(pattern: tuple[int, ...]) -> int:
        return min(int(left[part]) // pattern.count(part) for part in pattern)

    lengths = [int(x) for x in np.flatnonzero(left)]
    combos = combinations(lengths, window)
    repeats = solve_repeats(combos, histogram.astype(float))
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 0.5:
            break
        take(combos[k], min(int(round(repeats[k])), fits(combos[k])))
    # What is left: the longest piece first, then whatever still fits best; equal rows of it in bulk.
    while left.any():
        pattern: list[int] = []
        room, spare = window, left.copy()
        while room > 0 and (fit := np.flatnonzero(spare[: room + 1])).size:
            part = int(fit[-1])
            pattern.append(part)
            spare[part] -= 1
            room -= part
        take(tuple(pattern), max(1, fits(tuple(pattern))))
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]], window: int) -> dict[str, np.ndarray]:
    """Per length, runs of ranks: (first key = length * 2^40 + rank, first sequence, offset)."""
    used = np.zeros(window + 1, np.int64)
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for part in pattern:
            rows.append((part, int(used[part]), sequence, offset))
            used[part] += times
            offset += part
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 40) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack_documents(documents: DataFrame, window: int = WINDOW, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``ids`` (array<int>) are the piece's token ids; a sequence is the ids of its pieces by offset (see
    ``sequences``). Null and empty texts have one id (the end id). Equal rows are packed apart, each id
    once. Sequences hold at most ``window`` ids, offsets run without gaps. No documents: no rows. Extra
    columns are ignored.
    """
    spark = documents.sparkSession
    pieces = cut_pieces(documents, window, tokenizer=tokenizer).withColumn("uid", F.monotonically_increasing_id())
    pieces = store_rows(pieces, "pieces")  # numbers are fixed from here on

    by_length = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    share = max(BUCKET_PIECES, sum(by_length.values()) // MOST_BUCKETS)
    split = [(length, n // share + 1) for length, n in sorted(by_length.items())]
    n_buckets = F.broadcast(spark.createDataFrame(split, "length int, n_buckets long"))
    pieces = pieces.join(n_buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "uid"), F.col("n_buckets")))
    base = np.zeros(window + 2, np.int64)
    for length, n in split:
        base[length + 1] = n
    base = np.cumsum(base)
    first, histogram = np.zeros(base[-1], np.int64), np.zeros(window + 1, np.int64)
    for length, bucket, n in sorted(tuple(r) for r in pieces.groupBy("length", "bucket").count().collect()):
        first[base[length] + bucket] = histogram[length]
        histogram[length] += n
    held = spark.sparkContext.broadcast((base, first, _places(plan_sequences(histogram, window), window)))

    # Ranks are counted as the sorted rows stream by, so that no group of pieces is held with its ids.
    ranked = pieces.repartition("length", "bucket").sortWithinPartitions("length", "bucket", "doc_id", "start", "uid")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, first, own = held.value
        open_up = zstandard.ZstdDecompressor()
        group, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy().astype(np.int64)
            groups = base[length] + batch.column("bucket").to_numpy()
            edges = np.r_[0, np.flatnonzero(groups[1:] != groups[:-1]) + 1]
            n = np.arange(len(groups)) - np.repeat(edges, np.diff(np.r_[edges, len(groups)]))
            if groups[0] == group:
                n[: edges[1] if len(edges) > 1 else len(n)] += seen
            group, seen = groups[-1], int(n[-1]) + 1
            rank = first[groups] + n
            at = np.searchsorted(own["key"], (length << 40) + rank, "right") - 1
            sequence = own["sequence"][at] + rank - own["rank"][at]
            raw = [open_up.decompress(x) for x in batch.column("packed_ids").to_pylist()]
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            arrays = [batch.column("doc_id"), batch.column("start"), pa.array(length), ids, pa.array([zlib.crc32(x) for x in raw], pa.int64())]
            arrays += [batch.column("doc_tokens"), pa.array(sequence), pa.array(own["offset"][at])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return map_batches(ranked, place, "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long", BATCH_PIECES)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of ``pack_documents``: the ids of a sequence's pieces in the order of their offsets."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
