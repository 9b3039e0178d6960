"""Performance, forecast, risk and significance statistics.

Moments, lagged products and counts are aggregates, so a table of any number
of strategies or models takes one shuffle; what is left for the driver is a
solve of a few rows or the tail of a distribution.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.windows import Trail, ratio

ANN = 252.0


def sharpe(x: str | Column = "net", annual: bool = True) -> Column:
    """Mean over deviation; null below two values or without deviation."""
    sd = F.stddev_samp(x)
    out = F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / F.nullif(sd, F.lit(0.0)))
    return out * math.sqrt(ANN) if annual else out


def running_product(x: Column, w: Window) -> Column:
    """Product of a window's values, of either sign."""
    size = F.exp(F.sum(F.when(x != 0, F.ln(F.abs(x)))).over(w))
    sign = 1 - 2 * F.pmod(F.count_if(x < 0).over(w), F.lit(2))
    return F.when(F.count_if(x == 0).over(w) > 0, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * sign)


def drawdowns(rows: DataFrame, by: tuple[str, ...] = ("strategy",), x: str = "net") -> DataFrame:
    """equity, peak and drawdown.  The peak begins at the first equity value, not at 1."""
    w = Window.partitionBy(*by).orderBy("session_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("equity", running_product(1 + F.coalesce(F.col(x), F.lit(0.0)), w)).withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", ratio(F.col("equity"), F.col("peak")) - 1)


def longest_run(rows: DataFrame, flag: Column, by: tuple[str, ...]) -> DataFrame:
    """The longest run of rows in order where ``flag`` holds (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy("session_id")
    marked = rows.withColumn("__on", F.coalesce(flag, F.lit(False))).withColumn("__island", F.sum((~F.col("__on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("__on").groupBy(*by, "__island").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*by).distinct().join(runs.groupBy(*by).agg(F.max("n").alias("n")), list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("run"))


def performance(rows: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """The summary of rows (by, session_id, net, position, turnover): one aggregate, and one for the longest drawdown."""
    d = drawdowns(rows.where("net is not null"), by)
    n, years = F.count("net"), F.count("net") / ANN
    total = F.product(1 + F.col("net"))
    cagr = F.when(total > 0, F.pow(total, 1 / years) - 1).otherwise(-1.0)
    loss = -F.coalesce(F.sum(F.when(F.col("net") < 0, F.col("net"))), F.lit(0.0))
    gain = F.coalesce(F.sum(F.when(F.col("net") > 0, F.col("net"))), F.lit(0.0))
    down = F.sum(F.when(F.col("net") < 0, F.col("net") ** 2))
    q = lambda p: F.percentile("net", F.lit(p))
    mdd = F.min("drawdown")
    out = d.groupBy(*by).agg(
        n.alias("n"), (total - 1).alias("total_return"), cagr.alias("cagr"), (F.stddev_samp("net") * math.sqrt(ANN)).alias("ann_vol"), sharpe().alias("sharpe"),
        ratio(F.avg("net"), F.sqrt(down / n)).alias("sortino"), mdd.alias("max_drawdown"), F.when(mdd < 0, ratio(cagr, F.abs(mdd))).alias("calmar"),
        (F.count_if(F.col("net") > 0) / F.greatest(F.count_if(F.col("net") != 0), F.lit(1))).alias("hit_rate"), F.when(loss > 0, ratio(gain, loss)).alias("profit_factor"),
        F.skewness("net").alias("skew"), (F.kurtosis("net") + 3).alias("kurtosis"), F.abs(ratio(q(0.95), q(0.05))).alias("tail_ratio"),
        F.avg((F.abs("position") > 1e-12).cast("double")).alias("exposure"), F.avg(F.abs("position")).alias("avg_gross"), (F.sum("turnover") / years).alias("turnover_ann"),
    )
    out = out.withColumn("sortino", F.col("sortino") * math.sqrt(ANN))
    return out.join(longest_run(d, F.col("drawdown") < 0, by).withColumnRenamed("run", "max_dd_duration"), list(by)).where("n >= 2")


def newey_west_lags(n: int) -> int:
    return int(math.floor(4 * (n / 100.0) ** (2.0 / 9.0)))


def newey_west(rows: DataFrame, x: str, by: tuple[str, ...], order: str = "session_id", lags: int | None = None) -> DataFrame:
    """mean, HAC standard error and n of a series for each group.

    Autocovariances come from lagged products of demeaned values, one pass; the
    number of lags follows from the largest group, and each uses its own.
    """
    known = rows.where(F.col(x).isNotNull())
    most = newey_west_lags(known.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) if lags is None else lags
    w = Window.partitionBy(*by)
    o = w.orderBy(order)
    d = known.withColumns({"__m": F.avg(x).over(w), "__n": F.count(x).over(w)}).withColumn("__e", F.col(x) - F.col("__m"))
    d = d.withColumns({f"__p{k}": F.col("__e") * F.lag("__e", k).over(o) for k in range(1, most + 1)})
    agg = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("__m").alias("mean"), F.sum(F.col("__e") ** 2).alias("g0"), *[F.sum(f"__p{k}").alias(f"g{k}") for k in range(1, most + 1)])
    own = F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))) if lags is None else F.lit(lags)
    total = F.col("g0") / F.col("n")
    for k in range(1, most + 1):
        total = total + F.when(F.lit(k) <= own, 2 * (1 - F.lit(k) / (own + 1)) * F.coalesce(f"g{k}", F.lit(0.0)) / F.col("n")).otherwise(0.0)
    return agg.select(*by, "n", "mean", F.when(F.col("n") >= 3, F.sqrt(F.greatest(total, F.lit(0.0)) / F.col("n"))).alias("se"))


def average_rank(x: str, by: tuple[str, ...]) -> Column:
    """Ranks from 1, ties sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def information_coefficient(rows: DataFrame, by: tuple[str, ...] = ("model",), pred: str = "pred", y: str = "r") -> DataFrame:
    """ic, t of the time-series Spearman correlation, by products of standardised ranks."""
    known = rows.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
    ranked = known.withColumns({"__rp": average_rank(pred, by), "__ry": average_rank(y, by)})
    w = Window.partitionBy(*by)
    z = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), ratio(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)))
    prod = ranked.withColumn("prod", z("__rp") * z("__ry"))
    out = newey_west(prod, "prod", by)
    return out.select(*by, "n", F.col("mean").alias("ic"), ratio(F.col("mean"), F.col("se")).alias("t"))


def r2_oos(pred: str = "pred", y: str = "r", bench: Column | None = None) -> Column:
    b = F.lit(0.0) if bench is None else bench
    return 1 - ratio(F.sum((F.col(y) - F.col(pred)) ** 2), F.sum((F.col(y) - b) ** 2))


def diebold_mariano(d: str = "d") -> tuple[Column, Column]:
    """(statistic with the small-sample correction, mean difference) for one-step forecasts; positive: the first is worse."""
    n = F.count(d)
    dm = ratio(F.avg(d), F.stddev_pop(d) / F.sqrt(n))
    return dm * F.sqrt((n - 1) / n), F.avg(d)


def diebold_mariano_p(stat: float | None, n: int) -> float | None:
    return None if stat is None else 2 * dist.t_sf(abs(stat), n - 1)


def pesaran_timmermann(rows: DataFrame, by: tuple[str, ...] = ("model",), pred: str = "pred", y: str = "r") -> DataFrame:
    """hit_rate and the statistic; its p-value is the upper normal tail."""
    known = rows.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
    a, b = (F.col(pred) > 0).cast("double"), (F.col(y) > 0).cast("double")
    s = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((a == b).cast("double")).alias("hit_rate"), F.avg(b).alias("py"), F.avg(a).alias("px"))
    n, py, px = F.col("n"), F.col("py"), F.col("px")
    star = py * px + (1 - py) * (1 - px)
    v_hit = star * (1 - star) / n
    v_star = (2 * py - 1) ** 2 * px * (1 - px) / n + (2 * px - 1) ** 2 * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n)
    room = v_hit - v_star
    return s.select(*by, "n", F.when(n >= 10, F.col("hit_rate")).alias("hit_rate"), F.when((n >= 10) & (room > 1e-15), ratio(F.col("hit_rate") - star, F.sqrt(F.when(room > 0, room)))).alias("stat"))


# rolling risk


def var_historical(t: Trail, x: str, level: float, w: int) -> Column:
    return -t.quantile(x, 1 - level, w)


def var_parametric(t: Trail, x: str, level: float, w: int) -> Column:
    return -(t.mean(x, w) + dist.norm_ppf(1 - level) * t.std(x, w))


def adjusted_skew(t: Trail, x: str, w: int) -> Column:
    return t.agg(F.skewness, x, w) * math.sqrt(w * (w - 1)) / (w - 2)


def adjusted_kurtosis(t: Trail, x: str, w: int) -> Column:
    return ((w - 1) / ((w - 2) * (w - 3))) * ((w + 1) * t.agg(F.kurtosis, x, w) + 6)


def var_cornish_fisher(t: Trail, x: str, level: float, w: int) -> Column:
    z = dist.norm_ppf(1 - level)
    s, k = adjusted_skew(t, x, w), adjusted_kurtosis(t, x, w)
    q = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s**2 / 36
    return -(t.mean(x, w) + q * t.std(x, w))


def var_model(position: Column, var: Column, level: float, nu: float = 5.0) -> Column:
    """From a variance forecast, with a Student quantile of unit variance."""
    q = dist.t_ppf(1 - level, nu) * math.sqrt((nu - 2) / nu)
    return -(F.abs(position) * F.sqrt(var) * q)


def expected_shortfall(rows: DataFrame, t: Trail, x: str, level: float, w: int) -> DataFrame:
    """es: minus the mean of the window's values at or below its quantile."""
    r = rows.withColumns({"__w": F.collect_list(x).over(t.rows(w)), "__q": t.quantile(x, 1 - level, w)})
    tail = F.filter("__w", lambda v: v <= F.col("__q"))
    return r.withColumn("es", F.when(F.col("__q").isNotNull(), -F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail))).drop("__w", "__q")


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.ln(F.when(y > 0, y)))


def var_backtest(rows: DataFrame, by: tuple[str, ...], x: str, var: str, level: float, lag: int = 2) -> DataFrame:
    """Kupiec and Christoffersen likelihood ratios of exceptions against the VaR known at the decision."""
    t = Trail(*by)
    d = rows.withColumn("__v", t.lag(var, lag)).where(F.col(x).isNotNull() & (F.col("__v") > 0)).withColumn("__h", (-F.col(x) > F.col("__v")).cast("int"))
    d = d.withColumn("__b", t.lag("__h"))
    count = lambda a, b: F.count_if((F.col("__b") == a) & (F.col("__h") == b)).cast("double")
    s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__h").alias("exceptions"), count(0, 0).alias("n00"), count(0, 1).alias("n01"), count(1, 0).alias("n10"), count(1, 1).alias("n11"))
    p = 1 - level
    n, k = F.col("n").cast("double"), F.col("exceptions").cast("double")
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    one = lambda c: F.greatest(c, F.lit(1.0))
    rate, p01, p11, p1 = k / n, n01 / one(n00 + n01), n11 / one(n10 + n11), (n01 + n11) / one(n00 + n01 + n10 + n11)
    uc = -2 * (xlogy(n - k, F.lit(1 - p)) + xlogy(k, F.lit(p)) - xlogy(n - k, 1 - rate) - xlogy(k, rate))
    null = xlogy(n00 + n10, 1 - p1) + xlogy(n01 + n11, p1)
    alt = xlogy(n00, 1 - p01) + xlogy(n01, p01) + xlogy(n10, 1 - p11) + xlogy(n11, p11)
    enough = F.col("n") >= 20
    return s.select(*by, "n", "exceptions", F.when(enough, rate).alias("rate"), F.when(enough, uc).alias("lr_uc"), F.when(enough, -2 * (null - alt)).alias("lr_ind"))


def var_p_values(lr_uc: float, lr_ind: float) -> dict[str, float]:
    return {"kupiec": dist.chi2_sf(lr_uc, 1), "independence": dist.chi2_sf(lr_ind, 1), "coverage": dist.chi2_sf(lr_uc + lr_ind, 2)}


# selection under many trials

EULER = 0.5772156649015329


def psr(sr: float, n: int, skew: float, kurt: float, against: float = 0.0) -> float:
    room = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return math.nan if room <= 0 or n < 2 else dist.norm_cdf((sr - against) * math.sqrt(n - 1) / math.sqrt(room))


def expected_max_sharpe(trials: int, variance: float) -> float:
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * dist.norm_ppf(1 - 1 / trials) + EULER * dist.norm_ppf(1 - 1 / (trials * math.e)))


def min_track_record(sr: float, skew: float, kurt: float, against: float = 0.0, alpha: float = 0.05) -> float:
    if sr <= against:
        return math.inf
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (dist.norm_ppf(1 - alpha) / (sr - against)) ** 2


def moments(rows: DataFrame, by: tuple[str, ...] = ("strategy",), x: str = "net") -> DataFrame:
    return rows.groupBy(*by).agg(F.count(x).alias("n"), sharpe(x, False).alias("sr"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def deflated_sharpe(rows: DataFrame, strategy: str, trials: int | None = None) -> dict[str, float]:
    table = [r for r in moments(rows).collect() if r.sr is not None]  # a row for each strategy
    own = next(r for r in table if r.strategy == strategy)
    var = float(np.var([r.sr for r in table], ddof=1)) if len(table) > 1 else 0.0
    star = expected_max_sharpe(trials or len(table), var)
    return {"dsr": psr(own.sr, own.n, own.skew, own.kurt, star), "sr": own.sr, "sr_star": star, "variance": var, "n": own.n}


def pbo(spark: SparkSession, rows: DataFrame, blocks: int = 8, x: str = "net") -> DataFrame:
    """combo, logit, is_best, oos_best of every choice of half the blocks, from block sums: returns are read once.

    rows (strategy, session_id, x), dates where all strategies are known.
    """
    if blocks % 2 or not 2 <= blocks <= 20:
        raise ValueError("blocks are an even number up to 20: their halves are held by every task")
    full = rows.where(F.col(x).isNotNull())
    dates = full.groupBy("session_id").agg(F.collect_list(F.struct("strategy", F.col(x).alias("x"))).alias("xs"))  # a date holds each strategy once
    n = dates.select(F.explode("xs.strategy").alias("strategy")).agg(F.countDistinct("strategy").alias("n"))
    common = dates.join(F.broadcast(n), F.size("xs") == F.col("n")).select("session_id", "xs", (F.ntile(blocks).over(Window.orderBy("session_id")) - 1).alias("block"))
    stats = common.select("block", F.inline("xs")).groupBy("strategy", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = Window.partitionBy("strategy")
    stats = stats.withColumn("live", F.max("hi").over(w) > F.min("lo").over(w)).where("live")  # without variance there is no Sharpe
    halves = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2)  # block 0 is the highest bit
    halves = halves.select("id", (F.row_number().over(Window.orderBy(F.desc("id"))) - 1).cast("int").alias("combo"))
    sides = F.broadcast(halves.select("combo", F.inline(F.array(*[F.struct(F.lit(b).alias("block"), ((F.col("id").bitwiseAND(1 << (blocks - 1 - b))) != 0).alias("inside")) for b in range(blocks)]))))
    part = stats.join(sides, "block").groupBy("combo", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1)
    sr = part.withColumn("sr", ratio(F.col("s") / F.col("n"), F.sqrt(F.when(var > 1e-300, var))))
    wide = sr.groupBy("combo", "strategy").agg(F.max(F.when(F.col("inside"), F.col("sr"))).alias("is_sr"), F.coalesce(F.max(F.when(~F.col("inside"), F.col("sr"))), F.lit(0.0)).alias("oos_sr"))
    w = Window.partitionBy("combo")
    ranked = wide.withColumns({"rank": average_rank("oos_sr", ("combo",)), "m": F.count(F.lit(1)).over(w)})
    best = ranked.groupBy("combo").agg(F.max_by(F.struct("is_sr", "oos_sr", "rank", "m"), F.struct(F.coalesce("is_sr", F.lit(-1e300)), F.col("strategy"))).alias("b"))
    rel = F.col("b.rank") / (F.col("b.m") + 1)
    return best.select("combo", F.ln(rel / (1 - rel)).alias("logit"), F.col("b.is_sr").alias("is_best"), F.col("b.oos_sr").alias("oos_best"))


# regressions from sums


def gram(rows: DataFrame, xs: list[str], y: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Weighted sums of products of (1, xs, y) for each group: all that least squares needs."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    cols = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    known = rows.where(" and ".join(f"{c} is not null" for c in [*xs, y]))
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def gram_matrix(row, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    return g


def ols(rows: DataFrame, xs: list[str], y: str, order: str = "session_id", periods: int = 252) -> dict:
    """Least squares with HAC errors: two aggregates, and solves of len(xs) + 1 rows."""
    size = len(xs) + 2
    row = gram(rows, xs, y).first()
    n = row["n"]
    if n < 30:
        return {"n": n}
    g = gram_matrix(row, size)
    inv = np.linalg.inv(g[:-1, :-1])
    b = inv @ g[:-1, -1]
    known = rows.where(" and ".join(f"{c} is not null" for c in [*xs, y]))
    e = F.col(y) - b[0] - sum((F.col(x) * float(v) for x, v in zip(xs, b[1:], strict=True)), F.lit(0.0))
    w = Window.orderBy(order)
    h = known.select(order, e.alias("h0"), *[(e * F.col(x)).alias(f"h{k}") for k, x in enumerate(xs, 1)], e.alias("e"))
    lags = newey_west_lags(n)
    m = len(xs) + 1
    lagged = h.withColumns({f"l{k}_{i}": F.lag(f"h{i}", k).over(w) for k in range(1, lags + 1) for i in range(m)})
    sums = [F.sum(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"s0_{i}_{j}") for i in range(m) for j in range(m)]
    sums += [F.sum(F.col(f"h{i}") * F.col(f"l{k}_{j}")).alias(f"s{k}_{i}_{j}") for k in range(1, lags + 1) for i in range(m) for j in range(m)]
    s = lagged.agg(*sums, F.sum(F.col("e") ** 2).alias("sse")).first()
    at = lambda k: np.array([[s[f"s{k}_{i}_{j}"] or 0.0 for j in range(m)] for i in range(m)])
    meat = at(0)
    for k in range(1, lags + 1):
        meat = meat + (1 - k / (lags + 1)) * (at(k) + at(k).T)
    cov = inv @ meat @ inv
    se = np.sqrt(np.diag(cov))
    sst = g[-1, -1] - g[0, -1] ** 2 / n
    return {
        "n": n, "alpha": float(b[0]), "alpha_ann": float(b[0] * periods), "alpha_t": float(b[0] / se[0]), "betas": {x: {"beta": float(v), "t": float(v / q)} for x, v, q in zip(xs, b[1:], se[1:], strict=True)},
        "r2": float(1 - s["sse"] / sst), "cov": cov, "coef": b,
    }


def wald_unit(fit: dict) -> float:
    """p-value of (constant, slope) = (0, 1)."""
    d = np.array([fit["coef"][0], fit["coef"][1] - 1])
    f = float(d @ np.linalg.solve(fit["cov"], d)) / 2
    return dist.f_sf(f, 2, fit["n"] - 2)
