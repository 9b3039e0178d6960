"""Synthetic series: seeded, one task for each series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 1 / 252


def gbm(spark: SparkSession, n: int, drift: float = 0.1, vol: float = 0.3, start: float = 100.0, seed: int = 0) -> DataFrame:
    """session_id, price of a geometric Brownian motion: a window sum of seeded normals."""
    step = F.when(F.col("id") == 0, 0.0).otherwise((drift - vol * vol / 2) * DAY + vol * math.sqrt(DAY) * F.randn(seed))
    w = Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(0, n, 1, 1).select(F.col("id").alias("session_id"), step.alias("r")).select("session_id", (start * F.exp(F.sum("r").over(w))).alias("price"))


def garch_returns(n: int, omega: float, alpha: float, beta: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Percent returns and their variances."""
    if alpha + beta >= 1:
        raise ValueError("alpha + beta must be below 1")
    z, v, r = np.random.default_rng(seed).standard_normal(n), np.empty(n), np.empty(n)
    v[0] = omega / (1 - alpha - beta)
    for t in range(n):
        if t:
            v[t] = omega + alpha * r[t - 1] ** 2 + beta * v[t - 1]
        r[t] = math.sqrt(v[t]) * z[t]
    return r, v


def garch(spark: SparkSession, n: int, omega: float = 0.05, alpha: float = 0.08, beta: float = 0.9, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        s = int(p["seed"].iloc[0])
        r, v = garch_returns(n, omega, alpha, beta, s)
        return pd.DataFrame({"seed": s, "session_id": np.arange(n), "ret": r, "variance": v})

    garch_returns(1, omega, alpha, beta, 0)
    return spark.createDataFrame([(s,) for s in seeds], "seed int").groupBy("seed").applyInPandas(run, "seed int, session_id long, ret double, variance double")


def regime_switching(spark: SparkSession, n: int, stay: tuple[float, float] = (0.98, 0.95), vol: tuple[float, float] = (0.8, 2.5), seeds: tuple[int, ...] = (0,)) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        s = int(p["seed"].iloc[0])
        rng = np.random.default_rng(s)
        u, z, state = rng.random(n), rng.standard_normal(n), np.zeros(n, int)
        for t in range(1, n):
            state[t] = state[t - 1] if u[t] < stay[state[t - 1]] else 1 - state[t - 1]
        return pd.DataFrame({"seed": s, "session_id": np.arange(n), "ret": np.array(vol)[state] * z, "state": state})

    return spark.createDataFrame([(s,) for s in seeds], "seed int").groupBy("seed").applyInPandas(run, "seed int, session_id long, ret double, state int")


def planted_signal(spark: SparkSession, n: int, columns: int = 10, strength: float = 0.3, seed: int = 0) -> DataFrame:
    """x0..x9 and y = strength * x0 + noise."""
    xs = spark.range(0, n, 1, 1).select(F.col("id").alias("session_id"), *[F.randn(seed + k).alias(f"x{k}") for k in range(columns)])
    return xs.withColumn("y", strength * F.col("x0") + math.sqrt(1 - strength**2) * F.randn(seed + columns))


def market(spark: SparkSession, n: int = 700, peers: int = 3, signal: float = 0.0, seed: int = 3, start: str = "2018-01-02") -> DataFrame:
    """ticker, session_id, date and bars of a target and peers that share a GARCH market factor.

    A signal lets the target's session return lean against yesterday's.
    """
    base, _ = garch_returns(n, 0.02, 0.08, 0.9, seed)
    factor = base / base.std() * 0.18 * math.sqrt(DAY)
    sent = spark.sparkContext.broadcast(factor)
    names = ["ALL", *(f"P{k}" for k in range(peers))]
    days = pd.bdate_range(start, periods=n)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        name = p["ticker"].iloc[0]
        rng = np.random.default_rng((seed, names.index(name)))
        total = 1.2 * sent.value + 0.25 * math.sqrt(DAY) * rng.standard_normal(n)
        night = 0.4 * total + 0.002 * rng.standard_normal(n)
        day = total - night
        if signal and name == "ALL":
            for t in range(1, n):
                night[t] -= signal * (day[t - 1] + night[t - 1])
        close = 100 * np.exp(np.cumsum(night + day))
        open_ = close * np.exp(-day)
        up, down = np.abs(0.004 * rng.standard_normal((2, n)))
        return pd.DataFrame({"ticker": name, "session_id": np.arange(n), "date": [d.date() for d in days], "open": open_, "high": np.maximum(open_, close) * np.exp(up), "low": np.minimum(open_, close) * np.exp(-down), "close": close, "volume": 1e6 * np.exp(0.3 * rng.standard_normal(n))})

    return spark.createDataFrame([(x,) for x in names], "ticker string").groupBy("ticker").applyInPandas(run, "ticker string, session_id long, date date, open double, high double, low double, close double, volume double")
