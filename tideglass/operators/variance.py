"""Forecasts of tomorrow's variance from the realised one: HAR by least squares, boosted trees on features.

Both learn the logarithm of the next session's proxy and map it back with half
the residual variance, as a lognormal mean asks.  A ticker's rows, bounded by
its calendar, are one row of arrays; every (ticker, refit) is a unit of work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Ahead, Trail
from .features import ranges
from .models import Boosted

#: A forecaster of log variance: (training rows, their targets, rows to answer for) -> (forecasts, residual variance).
Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float]]


def proxy(g: DataFrame) -> DataFrame:
    """rv: squared overnight gap plus the session's Garman-Klass variance."""
    return g.withColumns({k: c for k, c in ranges(Trail()).items() if k in ("_yo", "_gk")}).withColumn("rv", F.when(F.col("_gk").isNotNull(), F.col("_yo") ** 2 + F.greatest("_gk", F.lit(0.0)))).drop("_yo", "_gk")


def har_inputs(g: DataFrame) -> DataFrame:
    """d, w, m: log variance of the session, its mean of 5 and of 22; next: that of the session after."""
    t = Trail()
    rows = proxy(g).withColumn("d", F.when(F.col("rv").isNotNull(), F.ln(F.greatest("rv", F.lit(1e-8)))))
    return rows.withColumns({"w": t.mean("d", 5), "m": t.mean("d", 22), "next": Ahead().lead("d")})


def har(X: np.ndarray, y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, float]:
    A = np.column_stack([np.ones(len(X)), X])
    b, *_ = np.linalg.lstsq(A, y, rcond=None)
    return np.column_stack([np.ones(len(new)), new]) @ b, float(((y - A @ b) ** 2).sum() / max(1, len(y) - A.shape[1]))


def boosted(X: np.ndarray, y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, float]:
    m = Boosted(trees=300, rate=0.03, depth=4, least=50).fit(X, y)
    return m.predict(new), float(np.var(y - m.predict(X)))


def walk_forward(rows: DataFrame, features: list[str], fit: Fit, refit_every: int = 21, first: int = 756, complete: bool = True) -> DataFrame:
    """ticker, session_id, var for sessions from the first refit on.

    rows: ticker, session_id, next and features, a row for each session whose
    inputs count as known: with ``complete`` those without a null, else all.  A
    refit at a row learns from rows before it, whose targets it can see; a row
    with a null target teaches nothing, a refit without enough rows (two for
    each coefficient) answers null.  Tickers of fewer than ``first`` rows give none.
    """
    if complete:
        rows = rows.na.drop(subset=features)
    cell = F.struct("session_id", "next", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    paths = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(cell)).alias("path")).where(F.size("path") >= first)
    work = paths.select("ticker", F.col("path.session_id").alias("ids"), F.col("path.next").alias("y"), F.flatten("path.x").alias("x"))
    work = work.withColumn("at", F.explode(F.sequence(F.lit(first - 1), F.size("ids") - 1, F.lit(refit_every))))
    width = len(features)

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in part:
            for u in pdf.itertuples(index=False):
                X, y = np.asarray(u.x, float).reshape(-1, width), np.asarray(u.y, float)
                new = slice(u.at, u.at + refit_every)
                known = np.flatnonzero(~np.isnan(y[: u.at]))
                var = np.full(len(y[new]), np.nan)
                if len(known) >= 2 * (width + 1):
                    pred, spread = fit(X[known], y[known], X[new])
                    var = np.exp(pred + spread / 2)
                out = pd.DataFrame({"ticker": u.ticker, "session_id": np.asarray(u.ids, np.int64)[new], "var": var})
                yield out.astype({"var": object}).where(out.notna(), None)

    return work.repartition("ticker", "at").mapInPandas(run, "ticker string, session_id long, var double")


def har_forecasts(g: DataFrame, **how: int) -> DataFrame:
    return walk_forward(har_inputs(g).select("ticker", "session_id", "next", "d", "w", "m"), ["d", "w", "m"], har, **how)


def boosted_forecasts(g: DataFrame, features: DataFrame, names: list[str], **how: int) -> DataFrame:
    """features: ticker, session_id and the named columns; nulls are a bin of their own."""
    rows = har_inputs(g).where("d is not null").select("ticker", "session_id", "next").join(features.select("ticker", "session_id", *names), ["ticker", "session_id"], "left")
    return walk_forward(rows, names, boosted, complete=False, **how)
