"""Structured Streaming forms: turn micro-batches, keyed counters, bounded tails, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events ``(ts, event_type)`` per window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def observed_counts(events: DataFrame, least: int = 2) -> DataFrame:
    """Running count of each key of ``(key)`` events and whether it has reached the gate (ST2, A2).

    The state is one number for each key; a batch gives one row for each key it holds.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "open": [n >= least]})

    return events.groupBy("key").applyInPandasWithState(step, "key string, n long, open boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def retried_questions(events: DataFrame, most: int = 3) -> DataFrame:
    """Pending questions by session: asked again at each turn until answered or ``most`` attempts (ST5).

    Events are ``(session_id, t, kind)`` with kinds asked, turn and answered.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, tries = state.get if state.exists else (False, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("t").itertuples():
            if row.kind == "asked":
                pending, tries = True, 1
            elif row.kind == "answered":
                pending = False
            elif row.kind == "turn" and pending:
                tries += 1
                pending = tries < most
                out.append((key[0], row.t, tries))
        state.update((pending, tries))
        yield pd.DataFrame(out, columns=["session_id", "t", "attempt"])

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, t long, attempt int", "pending boolean, tries int", "append", GroupStateTimeout.NoTimeout)


def changed_recalls(recalls: DataFrame) -> DataFrame:
    """Recalls ``(session_id, t, ids)`` whose ids differ from the session's last (ST2, W14)."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("t").itertuples():
            if row.ids != last:
                out.append((key[0], row.t, row.ids))
            last = row.ids
        state.update((last,))
        yield pd.DataFrame(out, columns=["session_id", "t", "ids"])

    return recalls.groupBy("session_id").applyInPandasWithState(step, "session_id string, t long, ids string", "ids string", "append", GroupStateTimeout.NoTimeout)


def turn_sink(events: DataFrame, handle, checkpoint: str):
    """Run ``handle(batch, id)`` on each micro-batch with one writer (ST1, ST4); returns the query. The archive is
    to be written first in ``handle``; checkpoints make a batch come again after a failure, so sinks key by id."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append").start()


def flushed(counts: DataFrame, every: int = 20) -> DataFrame:
    """Recall counters that are due for writing: every ``every``-th (ST7)."""
    return counts.filter(F.col("n") % every == 0)
