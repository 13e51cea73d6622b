"""Toxicity: a learnt lexicon in a trie, Levenshtein automata over it, and context windows around hits.

The lexicon (whole terms, and stems that open many terms) is learnt from a bounded sample of labelled
rows. Misspelled terms are caught by running each word through the intersection of the trie with a
Levenshtein automaton of one edit; the product automaton is made deterministic as words visit it. Hits are
scored with their context: how dense they stand in a window, and whether they are quoted or reported. A
small calibrated network turns the sums into a probability.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import is_training_row, labelled_sample, map_batches, stable_columns, store_rows
from tidewell.llm.quality import Network, fit_network

#: Bound of the labelled sample that the lexicon and the network are fitted on.
LABELLED_ROWS = 8_000
WORD = re.compile(r"[^\W_]+")
STEM_LENGTHS = range(4, 12)
#: A stem must open so many different words of toxic rows.
STEM_TERMS = 4
#: Misspellings are sought of terms with so many letters or more: an edit of a shorter one is too often another word.
FUZZY_LENGTH = 5
#: Bound of the lexicon.
LEXICON_TERMS = 50_000
#: Words that introduce someone else's words.
REPORTING = frozenset("said says wrote writes quoted quote called calls told asked reported claims dijo dice escribió dit écrit sagte schrieb".split())
CONTEXT_WORDS = 30
#: Share of its weight that a quoted or reported hit keeps.
QUOTED = 0.1
#: Byte table that blanks ASCII signs: what WORD finds in ASCII texts, without a pattern.
_BLANK = bytes(c if chr(c).isalnum() else 0x20 for c in range(128)) + bytes(range(128, 256))


def words_of(lower: str) -> list[str]:
    """The words of a lower-case text, as the lexicon is learnt from them."""
    if lower.isascii():
        return lower.encode().translate(_BLANK).decode("ascii").split()
    return WORD.findall(lower)


class Lexicon:
    """Weighted terms and stems with a deterministic automaton over words, built as it is used."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], common: frozenset[str]):
        self.common = common
        self.next: list[dict[str, int]] = [{}]
        self.term: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth: list[int] = [0]
        for weights, kind in ((terms, self.term), (stems, self.stem)):
            for word, weight in weights.items():
                kind[self._node(word)] = weight
        self.longest = [0] * len(self.next)
        for node in range(len(self.next) - 1, -1, -1):  # children have higher numbers
            own = self.depth[node] if self.term[node] else 0
            self.longest[node] = max([own, *(self.longest[c] for c in self.next[node].values())])
        self.states: list[tuple[frozenset[tuple[int, int]], int, float]] = []
        self.moves: list[dict[str, int]] = []
        self.numbers: dict[object, int] = {}
        self.start = self._state(self._closed({(0, 0)}), 0.0)

    def __getstate__(self) -> dict:
        return {"terms": self.term_weights(), "stems": self.stem_weights(), "common": self.common}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["terms"], state["stems"], state["common"])

    def term_weights(self) -> dict[str, float]:
        return self._all(self.term)

    def stem_weights(self) -> dict[str, float]:
        return self._all(self.stem)

    def _all(self, weights: list[float]) -> dict[str, float]:
        out, stack = {}, [(0, "")]
        while stack:
            node, word = stack.pop()
            if weights[node]:
                out[word] = weights[node]
            stack += [(child, word + c) for c, child in self.next[node].items()]
        return out

    def _node(self, word: str) -> int:
        node = 0
        for c in word:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.term.append(0.0)
                self.stem.append(0.0)
                self.depth.append(self.depth[node] + 1)
            node = self.next[node][c]
        return node

    def _closed(self, found: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With skipped term letters; only positions from which a long enough term can be reached by an edit."""
        out = set(found)
        for node, edits in found:
            if edits == 0:
                out |= {(child, 1) for child in self.next[node].values()}
        return frozenset((n, e) for n, e in out if e == 0 or self.longest[n] >= FUZZY_LENGTH)

    def _state(self, found: frozenset[tuple[int, int]], stem: float) -> int:
        key = (found, stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            exact = max([self.term[n] for n, e in found if e == 0], default=0.0)
            fuzzy = max([self.term[n] for n, e in found if e == 1 and self.depth[n] >= FUZZY_LENGTH], default=0.0)
            self.states.append((found, exact, fuzzy, stem))
            self.moves.append({})
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        """The state after letter ``c``; -1 where nothing can match any more."""
        found, _, _, stem = self.states[state]
        out = set()
        for node, edits in found:
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, edits))
                if edits == 0:
                    stem = max(stem, self.stem[child])
            if edits == 0:
                out.add((node, 1))
                out |= {(other, 1) for other in self.next[node].values()}
        closed = self._closed(out)
        to = self._state(closed, stem) if closed or stem else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[float, float]:
        """(weight as an exact term or by a stem, weight as a misspelled term) of a lower-case word."""
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return 0.0, 0.0
            state = to
        _, exact, fuzzy, stem = self.states[state]
        own = max(exact, stem)
        return own, 0.0 if own or word in self.common else fuzzy


def _entries(text: str) -> set[str]:
    """Words of a text, and their possible stems marked by a star."""
    words = {w for w in words_of(text.lower()) if len(w) >= 3 and not any(c.isdigit() for c in w)}
    return words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if k < len(w)}


def _entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, t0, t1, o0, o1): in how many toxic and other rows of either half of the sample an entry stands."""
    fields = ["entry", "t0", "t1", "o0", "o1"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y, half in zip(batch.column("text"), batch.column("y").to_pylist(), batch.column("half").to_pylist()):
                for entry in _entries(text.as_py() or ""):
                    counts.setdefault(entry, [0, 0, 0, 0])[half + (0 if y else 2)] += 1
            columns = [list(counts), *(zip(*counts.values()) if counts else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], fields)

    rows = map_batches(sample.select("text", "y", "half"), step, "entry string, t0 long, t1 long, o0 long, o1 long")
    return store_rows(rows.groupBy("entry").agg(*[F.sum(c).alias(c) for c in fields[1:]]), "entries")


def learn_lexicon(counts: DataFrame, totals: dict[str, int], halves: str = "01", least: int = 3, odds: float = 6.0, limit: int = LEXICON_TERMS) -> Lexicon:
    """Words and stems that stand in toxic rows ``odds`` times as often as in others; weights are log odds.

    Counting and choosing are Spark's work; what comes to the driver are the ``limit`` heaviest entries at most,
    and the ordinary words within an edit of one of them."""
    n, m = (reduce(operator.add, [F.col(c + h) for h in halves]) for c in "to")
    n_toxic, n_other = (sum(totals[c + h] for h in halves) for c in "to")
    rows = counts.select("entry", F.endswith("entry", F.lit("*")).alias("is_stem"), n.alias("n"), m.alias("m"))
    toxic_words = rows.filter("n > 0 AND NOT is_stem").select("entry")
    lengths = F.sequence(F.lit(STEM_LENGTHS[0]), F.least(F.lit(STEM_LENGTHS[-1]), F.length("entry") - 1))
    stems = toxic_words.filter(F.length("entry") > STEM_LENGTHS[0]).select(F.explode(F.transform(lengths, lambda k: F.concat(F.substring("entry", F.lit(1), k), F.lit("*")))).alias("entry"))
    opening = stems.groupBy("entry").count().filter(F.col("count") >= STEM_TERMS).select("entry")
    kept = rows.filter(F.col("n") >= least)
    kept = kept.filter("NOT is_stem").union(kept.filter("is_stem").join(opening, "entry", "left_semi").select(kept.columns))
    # The lower end of a rough interval, so that a chance excess of few rows does not make a term.
    spread = 1.3 * F.sqrt(1 / F.col("n") + F.when(F.col("m") > 0, 1 / (F.col("m") + 1)).otherwise(0.0))
    lift = F.log((F.col("n") + 0.2) / (n_toxic + 1)) - F.log((F.col("m") + 0.5) / (n_other + 1)) - spread
    heavy = kept.withColumn("lift", F.round(lift, 4)).filter(F.col("lift") >= math.log(odds) * 0.7).orderBy(F.desc("lift"), "entry").limit(limit)
    weights = {r.entry: r.lift for r in heavy.collect()}
    terms = {w: x for w, x in weights.items() if w[-1] != "*"}
    found = Lexicon(terms, {w[:-1]: x for w, x in weights.items() if w[-1] == "*"}, frozenset())
    held = counts.sparkSession.sparkContext.broadcast(found)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            yield batch.filter(pa.array([own.match(w)[1] > 0 for w in batch.column("entry").to_pylist()], pa.bool_()))

    common = map_batches(rows.filter("m >= 2 AND NOT is_stem").select("entry"), near, "entry string")
    return Lexicon(found.term_weights(), found.stem_weights(), frozenset(r.entry for r in common.collect()))


N_FEATURES = 10


class Scorer:
    """Features of a text's lexicon hits in their context."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.seen: dict[str, tuple[float, float] | None] = {}

    def _look_up(self, word: str) -> tuple[float, float] | None:
        if len(self.seen) > 400_000:
            self.seen.clear()
        found = self.lexicon.match(word)
        self.seen[word] = out = found if found[0] or found[1] else None
        return out

    def features(self, text: str) -> np.ndarray:
        lower = text.lower()
        words = words_of(lower)
        seen, look_up = self.seen, self._look_up
        hits = []
        for i, word in enumerate(words):
            found = seen.get(word, 0)
            if found == 0:
                found = look_up(word)
            if found is not None:
                hits.append((i, word, *found))
        out = np.zeros(N_FEATURES)
        if not hits:
            return out  # texts without hits score alike, whatever their length
        out[0] = math.log1p(len(words))
        quoted = self._quoted(lower, hits, words)
        best: dict[str, float] = {}
        places, weights = [], []
        for (i, word, exact, fuzzy), q in zip(hits, quoted):
            weight = (exact or 0.8 * fuzzy) * (QUOTED if q else 1.0)
            best[word] = max(best.get(word, 0.0), weight)
            places.append(i)
            weights.append(weight)
        w, at = np.array(weights), np.array(places)
        total = np.r_[0, np.cumsum(w)]
        dense = (total[np.searchsorted(at, at + CONTEXT_WORDS, "right")] - total[:-1]).max()
        out[1] = math.log1p(sum(best.values()))
        out[2] = max(best.values())
        out[3] = math.log1p(w.sum())
        out[4] = w.sum() / len(words) * 100 / 8
        out[5] = math.log1p(dense)
        out[6] = math.log1p(sum(x for _, _, x, _ in hits if x >= 3.5))
        out[7] = math.log1p(len(best))
        out[8] = sum(quoted) / len(hits)
        out[9] = math.sqrt(w.sum() / len(words))
        return out

    @staticmethod
    def _quoted(lower: str, hits: list, words: list[str]) -> list[bool]:
        """Whether each hit stands inside quotation marks of its line, or soon after a reporting word."""
        inside: list[bool] = []
        if any(c in lower for c in "\"“”«»„"):  # neither marks nor line ends stand inside words
            for line in lower.split("\n"):
                opened = False
                last = 0
                for m in re.finditer(r"[\"“”«»„]", line):
                    inside += [opened] * len(words_of(line[last : m.start()]))
                    last = m.end()
                    closes = opened and m.group() in "\"”“»" and '"“”«»'.count(m.group())
                    opened = not closes and (m.group() in '"“«„' or opened)
                inside += [False] * len(words_of(line[last:]))
        else:
            inside = [False] * len(words)
        return [inside[h[0]] or any(w in REPORTING for w in words[max(0, h[0] - 4) : h[0]]) for h in hits]


def train(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> tuple[Lexicon, Network]:
    """Lexicon and network from about ``limit`` labelled training rows, whose texts stay with the executors. The
    network sees each row with a lexicon learnt from the other half of the sample, as it will see unknown texts."""
    sample = labelled_sample(documents, labels, "toxic", limit)
    sample = store_rows(sample.select("doc_id", "text", "y", F.pmod("doc_id", F.lit(2)).cast("int").alias("half")), "labelled")
    totals = {c + h: 0 for c in "to" for h in "01"}
    totals |= {("t" if r.y else "o") + str(r.half): r["count"] for r in sample.groupBy("y", "half").count().collect()}
    counts = _entry_counts(sample)
    others = [learn_lexicon(counts, totals, half, least=2) for half in "10"]  # by the half that they score
    held = documents.sparkSession.sparkContext.broadcast(others)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(x) for x in held.value]
        for batch in batches:
            x = [scorers[h].features(t.as_py() or "").tolist() for t, h in zip(batch.column("text"), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = map_batches(sample, step, "doc_id long, y int, x array<double>").toArrow()
    ids, y = rows.column("doc_id").to_numpy().astype(np.uint64), rows.column("y").to_numpy().astype(np.int64)
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, ids * np.uint64(0x9E3779B97F4A7C15)))
    return learn_lexicon(counts, totals), fit_network(x[order], y[order], hidden=12)


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, model: tuple[Lexicon, Network] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Scores depend on the text alone, so that equal texts tie; null is scored as empty, a long text whole. Without
    labels, or with labels of one class, the score is that class's share (0.5 without any). An empty table gives
    no rows; null ids count as held out and are never learnt from. Repeated rows are scored each, extra columns
    ignored. The model (at most ``LEXICON_TERMS`` terms) is broadcast; documents are read once and not shuffled.
    """
    model = model or train(documents, labels)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, net = held.value
        scorer = Scorer(lexicon)
        for batch in batches:
            texts = batch.column("text")
            x = np.array([scorer.features(t.as_py() or "") for t in texts]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(net.probability(x), pa.float64())], ["doc_id", "held_out", "score"])

    rows = stable_columns(documents, "doc_id", "text").select("doc_id", (~is_training_row()).alias("held_out"), "text")
    scored = map_batches(rows, step, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
