"""Sizing, transaction costs and two independent backtest engines.

Strategies are rows, not loops: a forecast table crossed with a small table of
rules, all windows partitioned by strategy.  ``backtest`` is a plan of columns;
``event_backtest`` walks each strategy's dates in order and shares no code with
it, costs included, so that agreement means something.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import Trail, ratio


@dataclass(frozen=True)
class Sizing:
    target_vol: float = 0.35
    max_gross: float = 1.5
    scale_window: int = 252
    kelly: float = 0.25
    threshold: float = 0.0
    regime_threshold: float = 0.5


@dataclass(frozen=True)
class Costs:
    half_spread_bps: float = 1.0
    commission_bps: float = 0.5
    slippage: float = 0.02
    impact: float = 0.1
    aum: float = 1e7
    borrow_bps: float = 30.0


#: rule, how it sizes, long and short, whether the regime filter applies
RULES = (("sign", "sign", False, False), ("scaled", "scaled", False, False), ("voltarget", "voltarget", False, False), ("kelly", "kelly", False, False), ("sign_ls", "sign", True, False), ("voltarget_regime", "voltarget", False, True))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, how string, long_short boolean, regime boolean")


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high))


def check_variance(rows: DataFrame, var: str = "var") -> None:
    if rows.where(F.col(var) <= 0).limit(1).count():
        raise ValueError("a variance forecast must be positive")


def positions(forecasts: DataFrame, table: DataFrame, z: Sizing = Sizing()) -> DataFrame:
    """forecasts (model, session_id, pred, var, p_high, ..) x rules -> a position for each strategy and date."""
    t = Trail("strategy")
    rows = forecasts.crossJoin(F.broadcast(table)).withColumn("strategy", F.concat_ws("__", "model", "rule"))
    floor = F.when(F.col("long_short"), F.lit(-z.max_gross)).otherwise(F.lit(0.0))
    pred = F.col("pred")
    sign = F.coalesce((pred > z.threshold).cast("double") - F.when(F.col("long_short"), (pred < -z.threshold).cast("double")).otherwise(0.0), F.lit(0.0))
    scaled = clip(ratio(pred, 2 * t.std(pred, z.scale_window, min(63, z.scale_window))), floor, z.max_gross)
    lever = F.least(z.target_vol / F.sqrt(F.col("var") * 252.0), F.lit(z.max_gross))
    vol = clip(sign * F.when(F.col("var").isNotNull(), lever), floor, z.max_gross)
    kelly = clip(ratio(z.kelly * pred, F.col("var")), floor, z.max_gross)
    sized = F.when(F.col("how") == "sign", sign).when(F.col("how") == "scaled", scaled).when(F.col("how") == "voltarget", vol).when(F.col("how") == "kelly", kelly)
    on = ~F.col("regime") | (F.coalesce("p_high", F.lit(1.0)) <= z.regime_threshold)  # unknown is flat
    return rows.withColumn("position", F.when(on, F.coalesce(sized, F.lit(0.0))).otherwise(0.0))


def cost_rate(trade: Column, sigma: Column, adv: Column, c: Costs, aum: Column | None = None, flat_bps: Column | None = None) -> Column:
    """Cost for each unit traded; null where a trade lacks its inputs."""
    fixed = F.lit((c.half_spread_bps + c.commission_bps) * 1e-4)
    if flat_bps is not None:
        return flat_bps * 1e-4
    share = trade * (F.lit(c.aum) if aum is None else aum) / F.when(adv > 0, adv)
    return F.when(trade > 0, fixed + c.slippage * sigma + c.impact * sigma * F.sqrt(share)).otherwise(fixed)


def backtest(rows: DataFrame, c: Costs = Costs(), by: tuple[str, ...] = ("strategy",), aum: Column | None = None, flat_bps: Column | None = None, check: bool = False) -> DataFrame:
    """rows (by, session_id, position, r, sigma, adv) with turnover, gross, costs, net.  Dates of unknown return go first."""
    t = Trail(*by)
    live = rows.where("r is not null").withColumn("position", F.coalesce("position", F.lit(0.0)))
    live = live.withColumn("turnover", F.abs(F.col("position") - t.lag("position", 1, 0.0)))
    rate = cost_rate(F.col("turnover"), F.col("sigma"), F.col("adv"), c, aum, flat_bps)
    live = live.withColumn("rate", rate)
    if check and live.where("rate is null").limit(1).count():
        raise ValueError("cost inputs are missing on trade dates: begin after the warm-up")
    live = live.withColumn("costs", F.col("rate") * F.col("turnover") + c.borrow_bps * 1e-4 / 252 * F.greatest(-F.col("position"), F.lit(0.0)))
    live = live.withColumn("gross", F.col("position") * F.expm1("r"))
    return live.withColumn("net", F.col("gross") - F.col("costs")).drop("rate")


def event_backtest(rows: DataFrame, c: Costs = Costs(), by: str = "strategy") -> DataFrame:
    """The second engine: state carried from date to date, one strategy a group."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_id")
        held, out = 0.0, []
        for row in pdf.itertuples(index=False):
            if row.r is None or math.isnan(row.r):
                continue
            want = 0.0 if row.position is None or math.isnan(row.position) else row.position
            traded = abs(want - held)
            paid = 0.0
            if traded > 0:
                if not (row.adv > 0) or math.isnan(row.sigma):
                    raise ValueError("a trade needs volatility and volume")
                bps = c.half_spread_bps + c.commission_bps
                paid = traded * (bps / 10000 + row.sigma * (c.slippage + c.impact * math.sqrt(traded * c.aum / row.adv)))
            if want < 0:
                paid += -want * c.borrow_bps / 10000 / 252
            earned = want * (math.exp(row.r) - 1)
            out.append((getattr(row, by), row.session_id, want, traded, earned, paid, earned - paid))
            held = want
        return pd.DataFrame(out, columns=[by, "session_id", "position", "turnover", "gross", "costs", "net"])

    cols = rows.select(by, "session_id", *[F.col(x).cast("double").alias(x) for x in ("position", "r", "sigma", "adv")])
    return cols.groupBy(by).applyInPandas(walk, f"{by} string, session_id long, position double, turnover double, gross double, costs double, net double")


def engine_difference(a: DataFrame, b: DataFrame, by: str = "strategy") -> DataFrame:
    j = a.alias("a").join(b.alias("b"), [by, "session_id"], "full_outer")
    worst = F.greatest(*[F.abs(F.coalesce(F.col(f"a.{x}"), F.lit(1e9)) - F.coalesce(F.col(f"b.{x}"), F.lit(-1e9))) for x in ("net", "costs", "gross", "position")])
    return j.groupBy(by).agg(F.max(worst).alias("difference"), F.count(F.lit(1)).alias("n"))


def random_paths(spark: SparkSession, returns: np.ndarray, paths: int, exposure: float, length: float, seed: int = 7, chunk: int = 50) -> DataFrame:
    """Sharpe of long/flat two-state Markov positions: path, exposure, sharpe; one task for a chunk of paths, seeded by path."""
    sent = spark.sparkContext.broadcast(np.expm1(returns))

    def run(batches):
        r = sent.value
        leave, enter = min(1.0, 1 / length), min(1.0, exposure / max(1e-12, 1 - exposure) / length)
        for batch in batches:
            for i in batch["id"]:
                rng = np.random.default_rng((seed, int(i)))
                u = rng.random(len(r))
                p = np.empty(len(r))
                state = u[0] < exposure
                for k in range(len(r)):
                    if k:
                        state = u[k] >= leave if state else u[k] < enter
                    p[k] = state
                x = p * r
                sd = x.std(ddof=1) if len(x) > 1 else 0.0
                yield pd.DataFrame({"path": [int(i)], "exposure": [float(p.mean())], "sharpe": [float(x.mean() / sd * math.sqrt(252)) if sd > 0 else None]})

    return spark.range(0, paths, 1, max(1, -(-paths // chunk))).mapInPandas(run, "path long, exposure double, sharpe double")
