"""Keyed state for conversations: the last messages of a thread, the active thread of a user."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.memory import STM_MESSAGES

STM_ROW = "user_id string, thread_id string, seq long, role string, content string"
ACTIVE_ROW = "user_id string, thread_id string, seq long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_per_batch(n: int):
    """Keep at most ``n`` rows per thread of every record batch, so that a busy thread reaches its
    state as a few rows per task instead of all of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values("seq").groupby(["user_id", "thread_id"], sort=False, dropna=False).tail(n)
    return run


class Expiring(StatefulProcessor):
    """State of a key that is forgotten ``ttl`` milliseconds after its last row, by event time; null keeps it.

    Rows that come later than that start anew, whether or not the timer has fired. The timer removes the state of
    keys that never come back, once the watermark has passed it."""

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long") if self.ttl else None

    def last_seen(self) -> int | None:
        return self.seen.get()[0] if self.ttl and self.seen.exists() else None

    def keep_until(self, before: int | None, now: int | None) -> None:
        if self.ttl and now is not None and now != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl)
            self.handle.registerTimer(now + self.ttl)
            self.seen.update((now,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _millis(pdf: pd.DataFrame) -> list:
    """Milliseconds since 1970 of the rows, or nothing known where there is no time."""
    return [int(t.timestamp() * 1000) for t in pdf["ts"]] if "ts" in pdf else [None] * len(pdf)


class LastMessages(Expiring):
    """List state with the newest ``n`` messages; emits the whole window after each batch."""

    def __init__(self, n: int, ttl: int | None = None) -> None:
        super().__init__(ttl)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "seq long, role string, content string")

    def forget(self) -> None:
        self.kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window = {s: (s, r, c) for s, r, c in self.kept.get()}
        before = now = self.last_seen()
        for at, seq, role, content in sorted(
                (row for pdf in rows for row in zip(_millis(pdf), pdf["seq"], pdf["role"], pdf["content"])), key=lambda r: r[:2] if self.ttl else r[1]):
            if self.ttl:
                if now is not None and at > now + self.ttl:
                    window.clear()
                now = at if now is None else max(now, at)
            window[int(seq)] = (int(seq), role, content)
        last = [window[s] for s in sorted(window)[-self.n:]]
        self.kept.put(last)
        self.keep_until(before, now)
        yield pd.DataFrame({"user_id": key[0], "thread_id": key[1], "seq": [s for s, _, _ in last],
                            "role": [r for _, r, _ in last], "content": [c for _, _, c in last]})


def _state_mode(stream: DataFrame, ttl: int | None, delay: str) -> tuple[DataFrame, str]:
    return (stream, "None") if not ttl else (stream.withWatermark("ts", delay), "EventTime")


def stream_stm(messages: DataFrame, n: int = STM_MESSAGES, ttl: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """The message window of every thread that got messages in a batch. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).

    With ``ttl`` (milliseconds) messages have a timestamp ``ts``, and a thread without messages for that long begins
    with an empty window; its state is removed when the watermark, ``delay`` behind the newest row, has passed.
    Messages later than the watermark are dropped.
    """
    time = ["ts"] if ttl else []
    slim = messages.select("user_id", "thread_id", "seq", "role", "content", *time)
    if not ttl:  # gaps in time would be lost with the rows between
        slim = slim.mapInPandas(last_per_batch(n), STM_ROW)
    slim, mode = _state_mode(slim, ttl, delay)
    return slim.groupBy("user_id", "thread_id").transformWithStateInPandas(
        statefulProcessor=LastMessages(n, ttl), outputStructType=STM_ROW, outputMode="Update", timeMode=mode)


def _started(user: str, seq: int) -> str:
    return "thread_" + hashlib.md5(f"{user}:{seq}".encode()).hexdigest()[:8]


class ActiveThread(Expiring):
    """Value state: the thread last set, when, and the user's first request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("active", "thread_id string, set_seq long, first_seq long")

    def forget(self) -> None:
        self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user = key[0]
        thread, set_seq, first = self.state.get() if self.state.exists() else (None, -1, None)
        before = now = self.last_seen()
        for at, seq, asked in sorted((row for pdf in rows for row in zip(_millis(pdf), pdf["seq"], pdf["thread_id"])),
                                     key=lambda r: r[:2] if self.ttl else r[1]):
            if self.ttl:
                if now is not None and at > now + self.ttl:
                    thread, set_seq, first = None, -1, None
                now = at if now is None else max(now, at)
            seq = int(seq)
            first = seq if first is None else min(first, seq)
            if asked and seq > set_seq:
                thread, set_seq = (_started(user, seq) if asked.strip().lower() == "new" else asked), seq
        self.state.update((thread, set_seq, first))
        self.keep_until(before, now)
        yield pd.DataFrame({"user_id": [user], "thread_id": [thread or _started(user, first)], "seq": [max(set_seq, first)]})


def decisive_requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every record batch and user only the first request and the last that sets a thread."""
    for pdf in batches:
        pdf = pdf.assign(thread_id=pdf["thread_id"].fillna("")).sort_values("seq")
        first = pdf.groupby("user_id", sort=False).head(1)
        setting = pdf[pdf["thread_id"] != ""].groupby("user_id", sort=False).tail(1)
        yield pd.concat([first, setting]).drop_duplicates(["user_id", "seq"])


def stream_active_thread(requests: DataFrame, ttl: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """Active thread per user after each batch. With ``ttl`` (milliseconds) requests have a timestamp ``ts``, and a user
    who asked nothing for that long has no active thread any more; see :func:`stream_stm`."""
    slim = requests.select("user_id", "thread_id", "seq", *["ts"] * bool(ttl))
    if not ttl:
        slim = slim.mapInPandas(decisive_requests, ACTIVE_ROW)
    slim, mode = _state_mode(slim, ttl, delay)
    return slim.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=ActiveThread(ttl), outputStructType=ACTIVE_ROW, outputMode="Update", timeMode=mode)
