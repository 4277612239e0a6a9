"""The work queue: states, and the same state from a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS = 2
BREAKER = 12


def error_class(error: Column) -> Column:
    return F.when(error == "blocked_by_robots", "block").when(F.startswith(error, F.lit("http_4")), "fail").when(error.isNotNull(), "retry")


def next_state(error: Column, attempts: Column, passes_gate: Column) -> Column:
    """A claimed task's next state after its attempt."""
    kind = error_class(error)
    return F.when(kind == "block", "blocked").when((kind == "retry") & (attempts < ATTEMPTS), "queued").when(kind.isNotNull(), "failed").when(passes_gate, "success").otherwise("needs_review")


def streaks(events: DataFrame) -> DataFrame:
    """The current failure streak of each key from a stream (or table) of key, seq and ok, kept as state."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, longest = state.get if state.exists else (0, 0)
        for frame in frames:
            for ok in frame.sort_values("seq")["ok"]:
                streak = 0 if ok else streak + 1
                longest = max(longest, streak)
        state.update((streak, longest))
        yield pd.DataFrame({"key": [key[0]], "streak": [streak], "longest": [longest]})

    return events.groupBy("key").applyInPandasWithState(update, "key long, streak long, longest long", "streak long, longest long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts in event-time windows; later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
