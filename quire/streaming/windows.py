"""Keyed state for sliding windows: the counts of the windows that are still open, as runs of equal counts."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 1024  # of users: a call per user would cost more than the counting
MERGE = 1_000_000  # rows of a bucket and batch that are held before equal windows are added up
WHO = ["nobody", "user_id"]  # a null user would turn all users of a record batch into floats
RUN = [*WHO, "first", "windows", "n"]


def micros(interval: str) -> int:
    return pd.Timedelta(interval.lower().removeprefix("interval ")) // pd.Timedelta(microseconds=1)


def pane_counts(pane: int):
    """Events of every record batch per user and pane, so that a busy user reaches its state as a few rows per task.
    No window begins or ends within a pane, so the newest time of one stands for all its events."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            panes = pdf.assign(pane=pdf["at"] // pane).groupby([*WHO, "pane"], sort=False, dropna=False)["at"]
            yield panes.agg(at="max", n="size").reset_index().drop(columns="pane")
    return run


def add_up(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """One row per user and window, in order."""
    return pd.concat(parts).groupby([*WHO, "start"], dropna=False)["n"].sum().reset_index()


def to_runs(counts: pd.DataFrame, slide: int) -> pd.DataFrame:
    """Neighbouring windows of a user with the same count as one row: an event alone is one run. Takes rows in order."""
    cut = np.ones(len(counts), bool)
    cut[1:] = np.diff(counts["start"].to_numpy()) != slide
    for c in [*WHO, "n"]:
        value = counts[c].to_numpy()
        cut[1:] |= value[1:] != value[:-1]
    begins = np.flatnonzero(cut)
    return counts.iloc[begins].rename(columns={"start": "first"}).assign(windows=np.diff(np.r_[begins, len(counts)]))[RUN]


def from_runs(runs: pd.DataFrame, slide: int) -> pd.DataFrame:
    windows = runs["windows"].to_numpy(np.int64)
    counts = runs.iloc[np.repeat(np.arange(len(runs)), windows)].reset_index(drop=True)
    nth = np.arange(len(counts)) - np.repeat(np.cumsum(windows) - windows, windows)
    return counts.assign(start=counts["first"] + nth * slide)[[*WHO, "start", "n"]]


def open_windows(length: int, slide: int):
    """Add new counts to the open windows of a bucket of users; those whose end the watermark has reached go out and are
    forgotten. The timer is set to the next end, so that windows go out without new events, too."""
    def run(_key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, merged, held = [], 0, 0
        if state.exists:
            parts.append(from_runs(pd.DataFrame(dict(zip(RUN, state.get))), slide))
        for pdf in pdfs:
            parts.append(pdf[[*WHO, "start", "n"]])
            held += len(pdf)
            if held > max(MERGE, merged):
                parts = [add_up(parts)]
                merged, held = len(parts[0]), 0
        counts = add_up(parts) if held else parts[0]
        due = counts["start"] + length <= state.getCurrentWatermarkMs() * 1000
        still = counts[~due].reset_index(drop=True)
        if len(still):
            state.update(tuple(to_runs(still, slide)[c].tolist() for c in RUN))
            # A timer fires once the watermark is greater, a window ends once the watermark is there.
            state.setTimeoutTimestamp(max(1, -(-int(still["start"].min() + length) // 1000) - 1))
        else:
            state.remove()
        if due.any():
            yield to_runs(counts[due].reset_index(drop=True), slide)
    return run


def sliding_counts(events: DataFrame, length: str, slide: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Events (``user_id``, ``ts``) of a stream per user and sliding window: every window once, when the watermark has
    reached its end. A late event counts in those of its windows that are still open, the watermark drops the others.

    The state has a row per bucket of users, not one per user and window. ``buckets`` counts from a stream's start.
    """
    long, hop = micros(length), micros(slide)
    user = events.schema["user_id"].dataType
    who = f"nobody boolean, user_id {user.simpleString()}"
    known = events.where("ts is not null").select(
        F.col("user_id").isNull().alias("nobody"), F.coalesce("user_id", F.lit(0).cast(user)).alias("user_id"),
        F.unix_micros("ts").alias("at"))
    panes = known.mapInPandas(pane_counts(gcd(long, hop)), f"{who}, at long, n long").withColumn("ts", F.timestamp_micros("at"))
    windows = panes.withWatermark("ts", delay).select(*WHO, F.window("ts", length, slide).alias("w"), "n")
    runs = windows.select(
        F.pmod(F.xxhash64(*WHO), F.lit(buckets)).alias("bucket"), *WHO, F.window_time("w").alias("ts"),
        F.unix_micros("w.start").alias("start"), "n").groupBy("bucket").applyInPandasWithState(
        open_windows(long, hop), f"{who}, first long, windows long, n long",
        f"nobody array<boolean>, user_id array<{user.simpleString()}>, first array<long>, windows array<long>, n array<long>",
        "append", GroupStateTimeout.EventTimeTimeout)
    last = F.col("first") + (F.col("windows") - 1) * hop
    return runs.select(F.when(~F.col("nobody"), F.col("user_id")).alias("user_id"), "n", F.explode(
        F.sequence("first", last, F.lit(hop).cast("long"))).alias("start")).select(
        "user_id", F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("start") + long).alias("window_end"), "n")
