"""Streams with a state for each key that ends: value and list state, and event-time timers that clear it.

A key's state is dropped when the watermark has passed its last event by the time that the job names; what comes for
the key after that begins anew, and rows older than the watermark are left out by Spark. The jobs need the RocksDB state
store, which ``keyed_state`` sets on the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.sources.derived import LOW_CONFIDENCE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _time():
    return F.col("created_at").cast("timestamp")


def _sorted(parts: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """The columns of a key's rows in a micro-batch, in the order of the first two: what is held is these values alone."""
    held: list[list[np.ndarray]] = [[] for _ in columns]
    for part in parts:
        for own, name in zip(held, columns):
            own.append(part[name].to_numpy())
    whole = [np.concatenate(own) for own in held]
    order = np.lexsort((whole[1], whole[0]))
    return [own[order] for own in whole]


class _Ending(StatefulProcessor):
    """A processor whose key's states are cleared by one timer, moved along with the key's events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = self.open_states(handle)

    def open_states(self, handle: StatefulProcessorHandle) -> list:
        raise NotImplementedError

    def keep_until(self, micros: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(1, -(-int(micros) // 1000)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.states:
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, watermark: str) -> DataFrame:
    keyed_state(rows.sparkSession)
    return rows.withWatermark("created_at", watermark).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _RateLimit(_Ending):
    def __init__(self, rpm: int, window_us: int):
        self.rpm, self.window_us = max(1, rpm), window_us

    def open_states(self, handle: StatefulProcessorHandle) -> list:
        self.held = handle.getListState("held", "at long")
        return [self.held]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        accepted = np.fromiter((r[0] for r in self.held.get()) if self.held.exists() else (), np.int64)
        at, usage_id = _sorted(rows, ["at", "usage_id"])
        times = np.concatenate([accepted, np.empty(len(at), np.int64)])  # accepted times, and how many of them
        first, end = 0, len(accepted)
        out = np.zeros(len(at), bool)
        for k, t in enumerate(at):
            while first < end and t - times[first] > self.window_us:
                first += 1
            if end - first < self.rpm:
                times[end] = t
                end += 1
                out[k] = True
        kept = times[first:end]
        self.held.put([(int(t),) for t in kept]) if len(kept) else self.held.clear()
        self.keep_until(int(at[-1]) + self.window_us)
        yield pd.DataFrame({"tenant_id": key[0], "usage_id": usage_id, "accepted": out})


def rate_limit_stream(hits: DataFrame, rpm: int = 120, window_s: float = 60.0, watermark: str = "1 day") -> DataFrame:
    """(tenant_id, usage_id, accepted), exact: fewer than max(1, rpm) accepted hits of at most ``window_s`` before. State: the
    accepted times still in the window; gone when the watermark has passed a tenant's last hit by the window."""
    rows = hits.select("tenant_id", "usage_id", _time().alias("created_at"), F.unix_micros(_time()).alias("at"))
    return _run(rows, ["tenant_id"], _RateLimit(rpm, int(window_s * 1_000_000)), "tenant_id long, usage_id long, accepted boolean", watermark)


class _Cycles(_Ending):
    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def open_states(self, handle: StatefulProcessorHandle) -> list:
        self.asked = handle.getValueState("asked", "at long")
        return [self.asked]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = self.asked.get()[0] if self.asked.exists() else None
        at, _, role = _sorted(rows, ["at", "seq", "role"])
        out = []
        for r, t in zip(role, at):
            if r == "visitor":
                asked = int(t) if asked is None else asked
            elif asked is not None:
                out.append(int(t) // 1_000_000 - asked // 1_000_000)
                asked = None
        if asked is None:  # nothing open: no state
            self.asked.clear()
        else:
            self.asked.update((asked,))
            self.keep_until(int(at[-1]) + self.idle_us)
        yield pd.DataFrame({"tenant_id": [key[0]] * len(out), "session_id": [key[1]] * len(out), "wait_s": out})


def response_time_stream(messages: DataFrame, idle_s: int = 7 * 86_400, watermark: str = "1 day") -> DataFrame:
    """(tenant_id, session_id, wait_s) of every finished cycle. State: when the open question came; none without an open
    question, and gone when the watermark has passed the session's last message by ``idle_s``."""
    rows = messages.filter(F.col("role").isin("visitor", "ai", "agent")).select("tenant_id", "session_id", "seq", "role", _time().alias("created_at"), F.unix_micros(_time()).alias("at"))
    return _run(rows, ["tenant_id", "session_id"], _Cycles(idle_s * 1_000_000), "tenant_id long, session_id long, wait_s long", watermark)


STATE = "ai long, visitor long, clarify long, streak long, status string"


class _Sessions(_Ending):
    def __init__(self, stop_after: int, escalate_after: int, idle_us: int, closed_us: int):
        self.stop_after, self.escalate_after = stop_after, max(1, escalate_after)
        self.idle_us, self.closed_us = idle_us, closed_us

    def open_states(self, handle: StatefulProcessorHandle) -> list:
        self.state = handle.getValueState("state", STATE)
        return [self.state]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ai, visitor, clarify, streak, status = self.state.get() if self.state.exists() else (0, 0, 0, 0, "ai")
        at, seqs, roles, notes = _sorted(rows, ["at", "seq", "role", "note"])
        out = []
        for seq, role, note in zip(seqs, roles, notes):
            if role == "close":
                status = "closed"
            elif role == "takeover" and status != "closed":
                status = "human"
            elif role == "release" and status != "closed":
                clarify, streak, status = 0, 0, "ai"
            elif role == "visitor":
                visitor += 1
            elif role == "ai" and status == "ai":
                ai, streak, clarify = ai + 1, 0, 0
                status = "stopped" if self.stop_after and ai >= self.stop_after else status
            elif role == "system" and note and status == "ai":
                streak, clarify = streak + 1, clarify + 1
                status = "queued" if streak >= self.escalate_after else status
            out.append((key[0], seq, ai, visitor, clarify, streak, status))
        self.state.update((ai, visitor, clarify, streak, status))
        self.keep_until(int(at[-1]) + (self.closed_us if status == "closed" else self.idle_us))
        yield pd.DataFrame(out, columns=["session_id", "seq", "ai", "visitor", "clarify", "streak", "status"])


def session_state_stream(messages: DataFrame, stop_after: int = 0, escalate_after: int = 2, idle_s: int = 7 * 86_400, closed_s: int = 3600, watermark: str = "1 day") -> DataFrame:
    """(session_id, seq, ai, visitor, clarify, streak, status) after each message.

    Events beside messages come in ``role``: 'takeover' (a person answers, the AI is silent), 'release' (the AI again,
    counters at zero), 'close'. A low-confidence note lengthens the streak and queues the session at
    ``escalate_after``; an AI reply resets it; ``stop_after`` AI replies stop the session (0: never). A session's state
    is gone when the watermark has passed its last message by ``idle_s``, after a close by ``closed_s``."""
    note = F.coalesce(F.col("content").contains(LOW_CONFIDENCE), F.lit(False))
    rows = messages.select("session_id", "seq", "role", _time().alias("created_at"), note.alias("note"), F.unix_micros(_time()).alias("at"))
    return _run(rows, ["session_id"], _Sessions(stop_after, escalate_after, idle_s * 1_000_000, closed_s * 1_000_000), f"session_id long, seq long, {STATE}", watermark)
