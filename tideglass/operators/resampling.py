"""Bootstraps and tests built on them: a task for a chunk of replicates, seeded by replicate.

The return matrix (sessions x strategies) is bounded by the calendar and is
broadcast; replicates are rows of spark.range.  Streams differ from other
libraries', so numbers agree with them in distribution only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def optimal_block(x: np.ndarray) -> float:
    """Politis and White's block length for the stationary bootstrap."""
    x = np.asarray(x, float)
    n = len(x)
    e = x - x.mean()
    kn = max(5, int(math.sqrt(math.log10(n))))
    most = math.ceil(math.sqrt(n)) + kn
    acv = np.array([e[k:] @ e[: n - k] / n for k in range(min(n - 1, 2 * most) + 1)])
    if acv[0] <= 0:
        return 1.0
    rho = acv / acv[0]
    bound = 2 * math.sqrt(math.log10(n) / n)
    m = next((k for k in range(1, most) if (np.abs(rho[k : k + kn]) < bound).all()), most)
    m = min(2 * max(m, 1), len(acv) - 1)
    k = np.arange(-m, m + 1)
    lam = np.minimum(1, 2 * (1 - np.abs(k) / m))
    g = float((lam * np.abs(k) * acv[np.abs(k)]).sum())
    lrv = float((lam * acv[np.abs(k)]).sum())
    if lrv <= 0:
        return 1.0
    return float(min(max(1.0, (2 * g * g / (2 * lrv * lrv)) ** (1 / 3) * n ** (1 / 3)), math.ceil(min(3 * math.sqrt(n), n / 3))))


def stationary_index(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Rows of one replicate: blocks of geometric length that wrap around."""
    new = rng.random(n) < 1 / max(block, 1.0)
    new[0] = True
    at = np.flatnonzero(new)
    start = rng.integers(0, n, len(at))
    which = np.cumsum(new) - 1
    return (start[which] + np.arange(n) - at[which]) % n


def replicate(spark: SparkSession, data: np.ndarray, reps: int, block: float, seed: int, f: Callable[[np.ndarray], dict[str, float]], names: list[str], chunk: int = 50) -> DataFrame:
    """rep and the named numbers of ``f`` on each replicate of the rows of ``data``."""
    sent = spark.sparkContext.broadcast(np.asarray(data, float))

    def run(part):
        x = sent.value
        for pdf in part:
            out = []
            for i in pdf["id"]:
                got = f(x[stationary_index(len(x), block, np.random.default_rng((seed, int(i))))])
                out.append((int(i), *(float(got[n]) for n in names)))
            yield pd.DataFrame(out, columns=["rep", *names])

    return spark.range(0, reps, 1, max(1, -(-reps // chunk))).mapInPandas(run, "rep long, " + ", ".join(f"{n} double" for n in names))


def sharpe_of(x: np.ndarray) -> float:
    sd = x.std(ddof=1)
    return float(x.mean() / sd * math.sqrt(252)) if sd > 0 else math.nan


def sharpe_interval(spark: SparkSession, x: np.ndarray, reps: int = 500, seed: int = 42, level: float = 0.95) -> dict[str, float]:
    block = optimal_block(x)
    draws = replicate(spark, x, reps, block, seed, lambda v: {"sharpe": sharpe_of(v)}, ["sharpe"]).toPandas()["sharpe"].to_numpy()
    low, high = np.nanquantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return {"sharpe": sharpe_of(x), "low": float(low), "high": float(high), "block": block}


def equity_paths(spark: SparkSession, x: np.ndarray, reps: int = 500, seed: int = 42) -> dict[str, float]:
    def path(v: np.ndarray) -> dict[str, float]:
        eq = np.cumprod(1 + v)
        return {"terminal": eq[-1], "mdd": (eq / np.maximum.accumulate(eq) - 1).min()}

    d = replicate(spark, x, reps, optimal_block(x), seed, path, ["terminal", "mdd"]).toPandas()
    t, m = d["terminal"], d["mdd"]
    return {"terminal_p05": t.quantile(0.05), "terminal_p50": t.quantile(0.5), "terminal_p95": t.quantile(0.95), "prob_loss": float((t < 1).mean()), "mdd_p05": m.quantile(0.05), "mdd_p50": m.quantile(0.5)}


def hac_variance(d: np.ndarray, block: float) -> np.ndarray:
    """Long-run variances of columns with the stationary bootstrap's own weights."""
    n, q = len(d), 1 / max(block, 1.0)
    e = d - d.mean(axis=0)
    out = (e * e).mean(axis=0)
    for k in range(1, n):
        w = (1 - k / n) * (1 - q) ** k + k / n * (1 - q) ** (n - k)
        if w < 1e-6 and k < n - 20 / q:
            continue
        out = out + 2 * w * (e[k:] * e[:-k]).sum(axis=0) / n
    return np.maximum(out, 1e-300)


def spa(spark: SparkSession, bench: np.ndarray, models: np.ndarray, reps: int = 500, seed: int = 42) -> dict[str, float]:
    """Hansen's test of superior ability (lower, consistent, upper), White's reality check, and the test at equal volatility."""

    def test(m: np.ndarray, student: bool, s: int) -> dict[str, float]:
        d = m - bench[:, None]
        n, block = len(d), optimal_block(d.mean(axis=1))
        sd = np.sqrt(hac_variance(d, block)) if student else np.ones(d.shape[1])
        mean = d.mean(axis=0)
        stat = max(0.0, float((math.sqrt(n) * mean / sd).max()))
        cut = -sd * math.sqrt(2 * math.log(math.log(n))) / math.sqrt(n)
        center = {"lower": np.maximum(mean, 0), "consistent": np.where(mean >= cut, mean, 0.0), "upper": mean}
        boot = lambda v: {k: max(0.0, float((math.sqrt(n) * (v.mean(axis=0) - c) / sd).max())) for k, c in center.items()}
        b = replicate(spark, d, reps, block, s, boot, list(center)).toPandas()
        return {k: float((b[k] >= stat).mean()) for k in center}

    full = test(models, True, seed)
    live = models.std(axis=0) > 0
    matched = models[:, live] * (bench.std(ddof=1) / models[:, live].std(axis=0, ddof=1))
    return {"spa_lower": full["lower"], "spa_consistent": full["consistent"], "spa_upper": full["upper"], "reality_check": test(models, False, seed)["upper"], "vol_matched": test(matched, True, seed)["consistent"]}


def confidence_set(spark: SparkSession, losses: np.ndarray, names: list[str], reps: int = 300, seed: int = 42) -> dict[str, float]:
    """p-values of the model confidence set: the worst model goes until none is worse; bootstrap means are drawn once."""
    n, k = losses.shape
    block = max(optimal_block(losses[:, j]) for j in range(k))
    means = replicate(spark, losses, reps, block, seed, lambda v: {f"m{j}": x for j, x in enumerate(v.mean(axis=0))}, [f"m{j}" for j in range(k)]).drop("rep").toPandas().to_numpy()
    own, left, out, most = losses.mean(axis=0), list(range(k)), {}, 0.0
    while len(left) > 1:
        rel, brel = own[left] - own[left].mean(), means[:, left] - means[:, left].mean(axis=1, keepdims=True)
        sd = np.sqrt(np.maximum(((brel - rel) ** 2).mean(axis=0), 1e-300))
        t = rel / sd
        p = float(((np.abs((brel - rel) / sd)).max(axis=1) >= t.max()).mean())
        most = max(most, p)
        out[names[left[int(t.argmax())]]] = most
        left.pop(int(t.argmax()))
    return out | {names[left[0]]: 1.0}
