"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; one binary classifier over hashed byte n-grams is trained for each
bit, and a text gets the language whose codeword costs least under the classifiers' losses, each bit
weighted by how well its classifier did on validation rows. A small gap to the next codeword flags the
answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import column_bytes, is_training_row, map_batches, stable_columns, text_slices

BUCKETS = 2048
#: Training rows per language and in all (4 KB each on the driver): the bounds of the sample that is fitted on.
ROWS_PER_LANGUAGE, ROWS = 1500, 24_000
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def ngram_rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Square roots of byte 1-, 2- and 3-gram shares per text, hashed to BUCKETS columns, in row order."""
    for _, data, offsets in text_slices(batch, rows=256, limit=1 << 20):
        n = len(offsets) - 1
        b = _LOWER[data].astype(np.uint32)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * BUCKETS
        counts = np.zeros(n * BUCKETS, np.int64)
        if len(b):
            counts += np.bincount(row + b, minlength=n * BUCKETS)
            for k in (2, 3):
                if len(b) >= k:
                    code = b[: len(b) - k + 1]
                    for j in range(1, k):
                        code = code * np.uint32(257) + b[j : len(b) - k + 1 + j]
                    code = (code * np.uint32(2654435761)) >> np.uint32(21)
                    inside = row[k - 1 :] == row[: len(row) - k + 1]
                    counts += np.bincount(row[: len(code)][inside] + code[inside], minlength=n * BUCKETS)
        x = counts.reshape(n, BUCKETS).astype(np.float32)
        yield np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


def codewords(n: int, bits: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1/-1; of many random draws the one with the largest least distance."""
    rng = np.random.default_rng(seed)
    best, best_gap = None, -1
    for _ in range(400):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        for b in range(bits):  # each bit must split the languages
            if n > 1 and abs(int(code[:, b].sum())) == n:
                code[rng.integers(n), b] *= -1
        gap = min((int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)), default=bits)
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability-like score, ambiguous) per row."""
        margin = x @ self.weight + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = p[np.arange(len(x)), best]
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + 9
        return best, score, second - loss.min(1) < 1.0


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], bits: int = 0, rounds: int = 250) -> CodeModel:
    """Logistic regressions for all bits at once; the rows with number 4 mod 5 weigh the bits."""
    bits = bits or max(12, 4 * int(np.ceil(np.log2(max(len(languages), 2)))))
    code = codewords(len(languages), bits)
    hold = np.arange(len(x)) % 5 == 4
    target = code[y].astype(np.float32)
    share = 1.0 / np.bincount(y, minlength=len(languages)).clip(1)[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    fit_on = np.flatnonzero(~hold) if hold.any() and (~hold).any() else np.arange(len(x))
    xs, ts, ss = x[fit_on], target[fit_on], share[fit_on] / share[fit_on].sum()
    for t in range(1, rounds + 1):  # Adam on the whole sample
        g = -ts / (1 + np.exp(np.clip(ts * (xs @ w + b), -30, 30))) * ss
        grad = xs.T @ g + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.5 * g.sum(0)
    check = np.flatnonzero(hold) if hold.any() else fit_on
    right = ((x[check] @ w + b) * target[check] > 0).mean(0)
    trust = np.log((right + 0.02) / (1.02 - right)).clip(0.05)
    return CodeModel(languages, code.astype(np.float32), w, b, (trust / trust.mean()).astype(np.float32))


def train(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> CodeModel | None:
    """Fit on at most about ``rows_per_language`` training rows of each language, chosen by a hash of
    doc_id; features are computed by Spark, the sample's features go to the driver in half precision."""
    known = stable_columns(documents, "doc_id", "text", "lang").filter(is_training_row() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rows_per_language = min(rows_per_language, max(1, ROWS // len(languages)))
    u = F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, min(1.0, rows_per_language / n)).otherwise(chance)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in ngram_rows(batch):
                part = batch.slice(at, len(x))
                at += len(x)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = map_batches(known.filter(u < chance).select("lang", "text"), features, "lang string, x binary").limit(2 * rows_per_language * len(languages)).toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    y = np.searchsorted(languages, rows.column("lang").to_pylist())
    order = np.argsort([hash_row(r) for r in x], kind="stable")
    return fit(x[order], y[order], languages)


def hash_row(x: np.ndarray) -> int:
    """An order of training rows that doesn't depend on how they were partitioned."""
    import zlib

    return zlib.crc32(x.tobytes())


def has_letter(raw: bytes) -> bool:
    """A letter of any script."""
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def identify_languages(documents: DataFrame, model: CodeModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row of ``documents``.

    Null texts and texts without a letter get ``und`` with score 0; where no training row has a language
    every text does. A language seen alone is always answered. Equal texts get equal answers, repeated rows one
    each; of languages that tie the first in order is answered. Texts of any length are read whole; null ids
    count as held out; an empty table gives no rows. Extra columns are ignored.
    """
    model = model or train(documents)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            lettered = [has_letter(raw) for raw in column_bytes(batch, "text")] if own else [False] * len(batch)
            names, scores, unsure = ["und"] * len(batch), [0.0] * len(batch), [True] * len(batch)
            if own:
                at = 0
                for x in ngram_rows(batch):
                    best, score, ambiguous = own.decode(x)
                    for i in range(len(x)):
                        if lettered[at + i]:
                            names[at + i], scores[at + i], unsure[at + i] = own.languages[best[i]], float(score[i]), bool(ambiguous[i])
                    at += len(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores, pa.float64()), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = stable_columns(documents, "doc_id", "text").select("doc_id", (~is_training_row()).alias("held_out"), "text")
    return map_batches(rows, step, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
