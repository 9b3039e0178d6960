"""Structured Streaming forms of the causal operators; they run on batches alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def ohlcv() -> list:
    return [
        F.count(F.lit(1)).alias("n"), F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.sum("value").alias("volume"),
    ]


def hourly_bars(events: DataFrame, late: str | None = None) -> DataFrame:
    """event_type, hour and bars of ``value``; with ``late``, rows later than that are dropped and state is freed."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(*ohlcv()).select("event_type", F.col("w.start").alias("hour"), "n", "open", "high", "low", "close", "volume")


def sliding_bars(events: DataFrame, length: str = "6 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("event_type", F.window("ts", length, step).alias("w")).agg(*ohlcv()).select("event_type", F.col("w.start").alias("start"), "n", "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Activity sessions of every user."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def resolved_labels(decisions: DataFrame, outcomes: DataFrame, within: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Decisions joined to the outcomes that resolve them, at most ``within`` later: state is bounded by both watermarks."""
    d = decisions.withWatermark("ts", late).alias("d")
    o = outcomes.select(F.col("ts").alias("resolved_at"), F.col("event_type").alias("otype"), F.col("value").alias("outcome")).withWatermark("resolved_at", late).alias("o")
    return d.join(o, F.expr(f"otype = event_type and resolved_at > ts and resolved_at <= ts + interval {within}"))


class RunningEwm(StatefulProcessor):
    """An exponential mean for each key, kept as one value of state."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mean", "m double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for pdf in rows:
            for row in pdf.sort_values("ts").itertuples(index=False):
                m = row.value if m is None else (1 - self.alpha) * m + self.alpha * row.value
                n += 1
                out.append((key[0], row.event_id, m))
        self.state.update((m, n))
        yield pd.DataFrame(out, columns=["event_type", "event_id", "ewm"])

    def close(self) -> None:
        pass


def running_ewm(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """event_type, event_id, ewm of a stream, in arrival order of its micro-batches."""
    return events.groupBy("event_type").transformWithStateInPandas(RunningEwm(alpha), "event_type string, event_id long, ewm double", "Append", "None")
