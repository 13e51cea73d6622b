"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors come from one pass over the whole corpus: every word (hashed to a row) adds the fixed sparse
ternary index vectors of its neighbours to its context vector. The sums are integers, so their order does
not matter, and the table has a fixed size whatever the corpus. A document is the mean of its words'
vectors; a small numpy network on top is trained on a bounded sample of labelled rows and its
probabilities are calibrated by a temperature on rows kept back from that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import SLICE_BYTES, byte_codes, fold, is_training_row, labelled_sample, map_batches, mix64, odd_powers, stable_columns, text_slices, unfold

#: Rows of the word table (words are hashed to them), classes of word shapes, and dimensions of their vectors.
WORDS, SHAPES, DIM = 32_768, 64, 64
#: Bound of the labelled sample that the network is fitted on.
LABELLED_ROWS = 12_000

_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 letter or digit, 2 other signs
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_CODES = byte_codes(3)
_BASE = 0x9E3779B97F4A7C15
_known_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, kept for slices of the usual size."""
    if n <= len(_known_powers[0]):
        return _known_powers[0][:n], _known_powers[1][:n]
    both = odd_powers(_BASE, n), odd_powers(pow(_BASE, -1, 1 << 64), n)
    if n <= 2 * SLICE_BYTES:
        _known_powers[:] = both
    return both


def index_vectors(rows: int = WORDS + SHAPES, dim: int = DIM, ones: int = 4, seed: int = 11) -> np.ndarray:
    """Sparse ternary index vectors: half of ``ones`` places +1, half -1."""
    places = np.argpartition(np.random.default_rng(seed).random((rows, dim)), ones, axis=1)[:, :ones]
    out = np.zeros((rows, dim), np.int8)
    np.put_along_axis(out, places[:, : ones // 2], 1, axis=1)
    np.put_along_axis(out, places[:, ones // 2 :], -1, axis=1)
    return out


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, word row, shape row) of each token: runs of word bytes or of other signs."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    kind = _CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    size = np.diff(np.r_[starts, len(data)])

    def per_token(values: np.ndarray) -> np.ndarray:
        """Sums of a byte table's values over each token, by one running sum."""
        upto = np.zeros(len(data) + 1, values.dtype)
        np.cumsum(values, out=upto[1:])
        return upto[starts + size] - upto[starts]

    # A token's hash is its part of one running polynomial, moved back to where a text begins.
    forth, back = _powers(len(data))
    value = mix64(per_token(_CODES[data] * forth) * back[starts])
    upper, digits = per_token(_UPPER[data]), per_token(_DIGIT[data])
    kept = kind[starts] != 0
    doc = np.searchsorted(offsets, starts, "right")[kept] - 1
    value, size, upper, digits, sign = value[kept], size[kept], upper[kept], digits[kept], kind[starts][kept] == 2
    same = np.zeros(len(value), bool)
    if len(value):
        same[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    case = np.where(upper == 0, 0, np.where((upper == size) & (size > 1), 2, 1))
    shape = np.where(sign, 40 + np.minimum(size, 7), np.where(digits > 0, 36 + np.minimum(case, 2), case * 12 + np.minimum(size, 11)))
    shape = np.where(same, 56 + sign, shape)
    return doc, (value % np.uint64(WORDS)).astype(np.int64), WORDS + shape.astype(np.int64)


def context_sums(documents: DataFrame) -> np.ndarray:
    """Context vectors of all rows over the whole corpus: neighbours up to two tokens away."""
    rows = WORDS + SHAPES

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = index_vectors()
        places = [(sign, np.nonzero(base == sign)[1].astype(np.int32).reshape(rows, -1).T.copy()) for sign in (1, -1)]  # equally many a row
        total, shaped, tokens = np.zeros(rows * DIM, np.int32), np.zeros(WORDS * SHAPES, np.int32), 0

        def sums() -> Iterator[pa.RecordBatch]:
            out = total.reshape(rows, DIM).astype(np.int64)
            counts = shaped.reshape(WORDS, SHAPES).astype(np.float64)
            out[:WORDS] += np.rint(counts @ base[WORDS:]).astype(np.int64)
            out[WORDS:] += np.rint(counts.T @ base[:WORDS]).astype(np.int64)
            at = np.flatnonzero(out.any(1))
            for first in range(0, len(at), 2048):
                part = at[first : first + 2048]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32())] + [pa.array(out[part, d]) for d in range(DIM)], ["word"] + [f"d{d}" for d in range(DIM)])

        for batch in batches:
            for _, data, offsets in text_slices(batch):
                doc, word, shape = token_stream(data, offsets)
                tokens += len(doc)
                wide, narrow = word * DIM, word * SHAPES - WORDS
                for gap in (1, 2):
                    left = np.flatnonzero(doc[gap:] == doc[:-gap])
                    right = left + gap
                    # A word sees its neighbours' words, as index vectors; words and shapes that meet are counted.
                    for mine, theirs in ((left, right), (right, left)):
                        np.add.at(shaped, narrow[mine] + shape[theirs], np.int32(1))
                        seen, own = word[theirs], wide[mine]
                        for sign, some in places:
                            for place in some:
                                np.add.at(total, own + place[seen], np.int32(sign))
                if tokens > 100_000_000:  # no sum passes 32 bits
                    yield from sums()
                    total[:], shaped[:], tokens = 0, 0, 0
        yield from sums()

    schema = "word int, " + ", ".join(f"d{d} long" for d in range(DIM))
    sums = map_batches(stable_columns(documents, "text"), step, schema).groupBy("word").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)])
    out = np.zeros((rows, DIM))
    for batch in sums.toArrow().to_batches():  # a row per word row: fixed size
        out[batch.column(0).to_numpy()] = np.stack([batch.column(1 + d).to_numpy() for d in range(DIM)], 1)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Own index vector plus the context vector at unit length."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (index_vectors() + sums / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text's words, the mean of its shapes, and the log of its length. Each text is summed by
    itself in its own order, so that equal texts get equal rows wherever they stand."""
    parts = []
    for _, data, offsets in text_slices(batch, limit=1 << 18):
        n = len(offsets) - 1
        doc, word, shape = token_stream(data, offsets)
        out = np.zeros((n, 2 * DIM + 1), np.float32)
        if len(doc):
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            size = np.diff(np.r_[starts, len(doc)])
            own = doc[starts]
            out[own, :DIM] = np.add.reduceat(vectors[word], starts, axis=0) / size[:, None]
            shapes = np.bincount(doc * SHAPES + shape - WORDS, minlength=n * SHAPES).reshape(n, SHAPES)[own]
            out[own, DIM : 2 * DIM] = np.einsum("ns,sd->nd", shapes, vectors[WORDS:], dtype=np.float64) / size[:, None]
            out[own, -1] = np.log1p(size)
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, 2 * DIM + 1), np.float32)


@dataclass
class Network:
    """x -> tanh layer -> logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, seed: int = 1) -> Network:
    """Adam on four fifths of the rows, stopped and calibrated on the fifth that is kept back."""
    hold = np.arange(len(x)) % 5 == 4
    if len(set(y.tolist())) < 2 or len(x) < 10:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    mean, scale = x[~hold].mean(0), x[~hold].std(0) + 1e-4
    xs, ys = ((x - mean) / scale)[~hold], y[~hold].astype(np.float64)
    xh, yh = ((x - mean) / scale)[hold], y[hold].astype(np.float64)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best, best_loss, last, t = [a.copy() for a in p], np.inf, 0, 0
    for turn in range(rounds):
        order = rng.permutation(len(xs))
        for part in np.array_split(order, max(1, len(xs) // 512)):
            t += 1
            h = np.tanh(xs[part] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - ys[part]) / len(part)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [xs[part].T @ back + 1e-3 * p[0], back.sum(0), h.T @ e + 1e-3 * p[2], np.array([e.sum()])]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = _log_loss(np.tanh(xh @ p[0] + p[1]) @ p[2] + p[3][0], yh)
        if loss < best_loss - 1e-5:
            best, best_loss, last = [a.copy() for a in p], loss, turn
        elif turn - last > 40:
            break
    net = Network(mean, scale, best[0], best[1], best[2], float(best[3][0]))
    logits = net.logit(x[hold])
    net.temperature = float(min(np.geomspace(0.3, 12, 90), key=lambda s: _log_loss(logits / s, yh)))
    return net


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents; the network from about ``limit`` labelled training rows."""
    vectors = word_vectors(context_sums(documents))
    held = documents.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch, held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    sample = labelled_sample(documents, labels, "quality", limit).select("doc_id", "y", "text")
    rows = map_batches(sample, features, "doc_id long, y int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIM + 1)
    y, ids = rows.column("y").to_numpy(), rows.column("doc_id").to_numpy()
    order = np.argsort((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    return vectors, fit_network(x[order].astype(np.float64), y[order])


def _scored(documents: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """All columns of ``documents`` and ``quality_score``, without a shuffle."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields] + ["quality_score double"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = held.value
        for batch in batches:
            p = net.probability(pooled(batch, vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*names, "quality_score"])

    return map_batches(documents, step, schema)


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, model: tuple[np.ndarray, Network] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Scores depend on the text alone: equal texts score alike, null is scored as empty. Without labels, or
    with labels of one class, the score is that class's share (0.5 without any). An empty table gives no
    rows; null ids count as held out and are never learnt from. Texts of any length are scored whole, ties and
    repeated rows each. Extra columns are ignored.
    """
    model = model or train(documents, labels)
    rows = _scored(stable_columns(documents, "doc_id", "text"), model)
    return rows.select("doc_id", (~is_training_row()).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, model: tuple[np.ndarray, Network] | None = None) -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, all columns as they were. Nulls, empty and long
    texts, ties, repeated rows and empty tables as in ``score_quality``."""
    model = model or train(documents, labels)
    scored = _scored(fold(documents), model).filter(F.col("quality_score") >= threshold)
    return unfold(scored, documents.columns)
