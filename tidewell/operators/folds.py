"""Folds over ordered rows that no window expresses, and bounds for the sides of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; they are counted first.
BROADCAST_ROWS = 200_000


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, out: str, kind: str) -> DataFrame:
    """``rows`` with ``out`` = step(state, *inputs) of each row, in the order of its key; ``start`` makes a key's
    state, which ``step`` changes. Keys are dealt out and sorted by Spark and stream by: a task holds one batch and
    one state, however many rows a key has."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{out}` {kind}"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = state = None
        for part in parts:
            found = []
            for row in part[[*keys, *inputs]].astype(object).where(part[[*keys, *inputs]].notna(), None).itertuples(index=False, name=None):
                key = row[: len(keys)]
                if key != last:
                    last, state = key, start()
                found.append(step(state, *row[len(keys) :]))
            yield part.assign(**{out: pd.Series(found, index=part.index, dtype=object)})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def small_side(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` to be broadcast where they are counted and few, else as they are, for a shuffled join."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows
