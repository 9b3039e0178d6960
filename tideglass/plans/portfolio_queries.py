"""Queries of forecasts, sizing, costs and backtests on the pooled ticker."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import Trail, ln
from ..operators import labels as L
from ..operators import portfolio as P
from ..operators.metrics import drawdowns, sharpe
from ..operators.variance import proxy
from ..sources import market as M
from .feature_queries import RANGES, guard, lag
from .label_queries import lead
from .query import query

#: First decision date: volatility, volume and 252 resolved labels exist.
START = 300


def market_inputs(spark, sf, name: str | None = M.TARGET):
    """ticker, session_id, date, open, close, lr, r (holding return), sigma, adv, var, p_high."""
    t = Trail()
    g = M.grid(spark, sf)
    if name:
        g = g.where(F.col("ticker") == name)
    g = g.withColumns({"lr": t.diff(ln("close")), "r": L.holding_return(), "dollar": F.col("close") * F.col("volume")})
    g = g.withColumns({"sigma": t.std("lr", 63), "s21": t.std("lr", 21), "a": t.mean("dollar", 20), "m21": t.diff(ln("close"), 21)})
    return g.withColumns({"adv": t.lag("a"), "var": F.col("sigma") ** 2, "p_high": 1 / (1 + F.exp(-4 * (ln("s21") - ln("sigma"))))}).drop("a", "dollar")


MARKET = f"""{RANGES},
m0 AS (SELECT ticker, session_id, date, open, close, volume, r AS lr, ln({lead('open', 2)}) - ln({lead('open')}) AS r, close * volume AS dollar, ln(close) - ln({lag('close', 21)}) AS m21 FROM ranges),
m1 AS (SELECT *, {guard('stddev_samp({})', 'lr', 63)} AS sigma, {guard('stddev_samp({})', 'lr', 21)} AS s21, {guard('avg({})', 'dollar', 20)} AS a FROM m0),
m2 AS (SELECT *, {lag('a')} AS adv, sigma * sigma AS var, 1 / (1 + exp(-4 * (ln(s21) - ln(sigma)))) AS p_high FROM m1),
mk AS (SELECT * FROM m2 WHERE ticker = 'ALL')"""


def forecasts(spark, sf):
    """model, session_id, pred and the market inputs from START on.  hist_mean averages the labels resolved by then."""
    m = market_inputs(spark, sf)
    known = Window.partitionBy("ticker").orderBy("session_id").rowsBetween(Window.unboundedPreceding, -2)
    m = m.withColumn("past", F.avg("r").over(known)).where(F.col("session_id") >= START)
    preds = F.map_from_arrays(F.array(*map(F.lit, ("hist_mean", "reversal", "trend", "zero"))), F.array("past", -0.1 * F.col("lr"), F.col("m21") / 21, F.lit(0.0)))
    return m.select("*", F.explode(preds).alias("model", "pred"))


FORE = f"""{MARKET},
past AS (SELECT *, avg(r) OVER (ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS past FROM mk),
fore AS (SELECT 'hist_mean' AS model, past AS pred, * FROM past WHERE session_id >= {START} UNION ALL SELECT 'reversal', -0.1 * lr, * FROM past WHERE session_id >= {START}
  UNION ALL SELECT 'trend', m21 / 21, * FROM past WHERE session_id >= {START} UNION ALL SELECT 'zero', 0.0, * FROM past WHERE session_id >= {START})"""
_SCALE = "stddev_samp(pred) OVER (PARTITION BY model ORDER BY session_id ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
_COUNT = "count(pred) OVER (PARTITION BY model ORDER BY session_id ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
POS = f"""{FORE},
raw AS (SELECT *, CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END AS up, CASE WHEN pred < 0 THEN 1.0 ELSE 0.0 END AS down, CASE WHEN {_COUNT} >= 63 THEN pred / nullif(2 * {_SCALE}, 0) END AS sc, least(0.35 / sqrt(var * 252), 1.5) AS lever FROM fore),
pos AS (SELECT model || '__' || rule AS strategy, model, rule, session_id, date, r, sigma, adv, var, position FROM (
  SELECT *, 'sign' AS rule, up AS position FROM raw UNION ALL SELECT *, 'scaled', coalesce(least(greatest(sc, 0), 1.5), 0) FROM raw UNION ALL
  SELECT *, 'voltarget', coalesce(least(greatest(up * lever, 0), 1.5), 0) FROM raw UNION ALL SELECT *, 'kelly', coalesce(least(greatest(0.25 * pred / var, 0), 1.5), 0) FROM raw UNION ALL
  SELECT *, 'sign_ls', up - down FROM raw UNION ALL SELECT *, 'voltarget_regime', CASE WHEN coalesce(p_high, 1) <= 0.5 THEN coalesce(least(greatest(up * lever, 0), 1.5), 0) ELSE 0 END FROM raw))"""


def bt_sql(source: str, by: str = "strategy", rate: str | None = None, out: str = "bt") -> str:
    """A backtest of (by, session_id, position, r, sigma, adv) as two more tables."""
    rate = rate or "CASE WHEN turnover > 0 THEN 0.00015 + 0.02 * sigma + 0.1 * sigma * sqrt(turnover * 1e7 / adv) ELSE 0.00015 END"
    return f"""t_{out} AS (SELECT *, abs(position - lag(position, 1, 0) OVER (PARTITION BY {by} ORDER BY session_id)) AS turnover FROM (SELECT * REPLACE (coalesce(position, 0) AS position) FROM {source} WHERE r IS NOT NULL)),
{out} AS (SELECT *, position * (exp(r) - 1) AS gross, ({rate}) * turnover + 0.003 / 252 * greatest(-position, 0) AS costs, position * (exp(r) - 1) - (({rate}) * turnover + 0.003 / 252 * greatest(-position, 0)) AS net FROM t_{out})"""


BT = f"{POS}, {bt_sql('pos')}"
_BY = "strategy session_id"


def strategies(spark, sf):
    return P.positions(forecasts(spark, sf), P.rules(spark))


def grid_run(spark, sf):
    """The whole strategy grid in one plan."""
    return P.backtest(strategies(spark, sf))


query("m02_hist_mean", "model session_id", "pred", sql="SELECT model, session_id, pred FROM fore", tables=FORE, digits=9)(forecasts)
for _id, _rule in (("t01_sign", "sign"), ("t01b_long_short", "sign_ls"), ("t02_scaled", "scaled"), ("t03_vol_target", "voltarget"), ("t04_kelly", "kelly"), ("t05_regime_filter", "voltarget_regime")):
    query(_id, _BY, "position", sql=f"SELECT * FROM pos WHERE rule = '{_rule}'", tables=POS)(lambda s, d, rule=_rule: strategies(s, d).where(F.col("rule") == rule))
query("t06_sizing_dispatch", _BY, "position", sql="SELECT * FROM pos", tables=POS)(strategies)
query("t08_vectorized", _BY, "net gross costs position turnover", sql="SELECT * FROM bt", tables=BT, digits=8)(grid_run)
query("t09_event_engine", _BY, "net gross costs position turnover", sql="SELECT * FROM bt", tables=BT, digits=8)(lambda s, d: P.event_backtest(strategies(s, d)))
query("t10_engine_agreement", "strategy agree n", sql="SELECT strategy, true AS agree, count(*) AS n FROM bt GROUP BY strategy", tables=BT)(
    lambda s, d: P.engine_difference(grid_run(s, d).select("strategy", "session_id", "net", "costs", "gross", "position"), P.event_backtest(strategies(s, d))).withColumn("agree", F.col("difference") < 1e-10)
)
query("j14_cross_rules", "strategy session_id", sql="SELECT strategy, session_id FROM pos", tables=POS)(strategies)


@query("t07_cost_rate", _BY, "rate", sql="SELECT strategy, session_id, CASE WHEN turnover > 0 THEN 0.00015 + 0.02 * sigma + 0.1 * sigma * sqrt(turnover * 1e7 / adv) ELSE 0.00015 END AS rate FROM bt", tables=BT, digits=9)
def _rate(spark, sf):
    rows = grid_run(spark, sf)
    return rows.withColumn("rate", P.cost_rate(F.col("turnover"), F.col("sigma"), F.col("adv"), P.Costs()))


def benchmarks(spark, sf):
    """strategy, session_id, position, r, sigma, adv: buy and hold, vol-targeted, trend, and two funds held."""
    t = Trail()
    m = market_inputs(spark, sf).withColumn("side", F.when(F.col("close") > t.mean("close", 200), 1.0).otherwise(0.0))
    hold = F.map_from_arrays(F.array(*map(F.lit, ("buy_hold", "buy_hold_voltarget", "trend_200"))), F.array(F.lit(1.0), F.least(0.35 / F.sqrt(F.col("var") * 252), F.lit(1.5)), "side"))
    own = m.where(F.col("session_id") >= START).select("session_id", "r", "sigma", "adv", F.explode(hold).alias("strategy", "position"))
    funds = market_inputs(spark, sf, None).where(F.col("ticker").isin(M.SECTOR, M.BROAD) & (F.col("session_id") >= START))
    return own.unionByName(funds.select("session_id", "r", "sigma", "adv", F.concat(F.lit("hold_"), "ticker").alias("strategy"), F.lit(1.0).alias("position"))).where("sigma is not null and adv is not null")


BENCH = f"""{MARKET},
side AS (SELECT *, CASE WHEN close > {guard('avg({})', 'close', 200)} THEN 1.0 ELSE 0.0 END AS side FROM mk),
bench AS (SELECT * FROM (SELECT 'buy_hold' AS strategy, session_id, 1.0 AS position, r, sigma, adv FROM mk UNION ALL SELECT 'buy_hold_voltarget', session_id, least(0.35 / sqrt(var * 252), 1.5), r, sigma, adv FROM mk
  UNION ALL SELECT 'trend_200', session_id, side, r, sigma, adv FROM side UNION ALL SELECT 'hold_' || ticker, session_id, 1.0, r, sigma, adv FROM m2 WHERE ticker IN ('A', 'N')) WHERE session_id >= {START} AND sigma IS NOT NULL AND adv IS NOT NULL),
{bt_sql('bench')}"""
query("t11_benchmarks", _BY, "net position turnover", sql="SELECT * FROM bt", tables=BENCH, digits=8)(lambda s, d: P.backtest(benchmarks(s, d)))


SHARPE = "CASE WHEN count(net) >= 2 AND stddev_samp(net) > 0 THEN avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) END"
_RANKED = f"SELECT strategy, {SHARPE} AS sharpe, avg(net) * 252 AS mean FROM bt GROUP BY strategy"
query("t12_strategy_grid", "strategy", "sharpe mean", sql=_RANKED, tables=BT)(lambda s, d: grid_run(s, d).groupBy("strategy").agg(sharpe().alias("sharpe"), (F.avg("net") * 252).alias("mean")))


@query("t13_cost_sweep", "strategy bps", "sharpe", sql=f"SELECT strategy, bps, {SHARPE} AS sharpe FROM bt GROUP BY strategy, bps", tables=f"{POS}, swept AS (SELECT * FROM pos CROSS JOIN (VALUES (0), (1), (2), (5), (10), (15), (20)) b(bps)), {bt_sql('swept', 'strategy, bps', 'bps * 0.0001')}")
def _cost_sweep(spark, sf):
    sweep = spark.createDataFrame([(b,) for b in (0, 1, 2, 5, 10, 15, 20)], "bps int")
    rows = strategies(spark, sf).crossJoin(F.broadcast(sweep))
    return P.backtest(rows, by=("strategy", "bps"), flat_bps=F.col("bps")).groupBy("strategy", "bps").agg(sharpe().alias("sharpe"))


_CAPACITY = (1e6, 1e7, 1e8, 1e9, 1e10, 3e10)


@query("t13b_capacity_sweep", "strategy aum", "sharpe", sql=f"SELECT strategy, aum, {SHARPE} AS sharpe FROM bt GROUP BY strategy, aum", tables=f"{POS}, swept AS (SELECT * FROM pos CROSS JOIN (VALUES (1000000), (10000000), (100000000), (1000000000), (10000000000), (30000000000)) b(aum)), {bt_sql('swept', 'strategy, aum', 'CASE WHEN turnover > 0 THEN 0.00015 + 0.02 * sigma + 0.1 * sigma * sqrt(turnover * aum / adv) ELSE 0.00015 END')}")
def _capacity(spark, sf):
    sweep = spark.createDataFrame([(int(a),) for a in _CAPACITY], "aum long")
    rows = strategies(spark, sf).crossJoin(F.broadcast(sweep))
    return P.backtest(rows, by=("strategy", "aum"), aum=F.col("aum")).groupBy("strategy", "aum").agg(sharpe().alias("sharpe"))


@query("t14_best_strategy", "strategy", "sharpe", sql=f"SELECT strategy, sharpe FROM ({_RANKED}) WHERE sharpe IS NOT NULL ORDER BY round(sharpe, 9) DESC, strategy LIMIT 1", tables=BT)
def _best(spark, sf):
    ranked = grid_run(spark, sf).groupBy("strategy").agg(sharpe().alias("sharpe")).where("sharpe is not null")
    return ranked.orderBy(F.round("sharpe", 9).desc(), "strategy").limit(1)


EQUITY = """CASE WHEN count(*) FILTER (1 + net = 0) OVER w > 0 THEN 0.0 ELSE coalesce(exp(sum(CASE WHEN 1 + net <> 0 THEN ln(abs(1 + net)) END) OVER w), 1) * (1 - 2 * (count(*) FILTER (1 + net < 0) OVER w % 2)) END"""


@query(
    "flagship_trend_backtest", "strategy", "n total_return ann_vol sharpe max_drawdown turnover",
    sql=f"SELECT strategy, count(*) AS n, arg_max(eq, session_id) - 1 AS total_return, stddev_samp(net) * sqrt(252) AS ann_vol, {SHARPE} AS sharpe, min(eq / nullif(top, 0) - 1) AS max_drawdown, sum(turnover) AS turnover FROM (SELECT *, max(eq) OVER (ORDER BY session_id) AS top FROM (SELECT *, {EQUITY} AS eq FROM bt WINDOW w AS (ORDER BY session_id))) GROUP BY strategy",
    tables=f"{MARKET}, side AS (SELECT 'trend_50' AS strategy, session_id, r, sigma, adv, CASE WHEN close > {guard('avg({})', 'close', 50)} THEN 1.0 ELSE 0.0 END AS position FROM mk), begun AS (SELECT * FROM side WHERE session_id >= {START}), {bt_sql('begun')}",
)
def flagship(spark, sf):
    """A 50-session trend rule on the pooled ticker: scan, bars, grid, windows, costs, performance."""
    t = Trail()
    m = market_inputs(spark, sf).withColumns({"position": F.when(F.col("close") > t.mean("close", 50), 1.0).otherwise(0.0), "strategy": F.lit("trend_50")})
    eq = drawdowns(P.backtest(m.where(F.col("session_id") >= START)))
    return eq.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("equity", "session_id") - 1).alias("total_return"), (F.stddev_samp("net") * F.sqrt(F.lit(252.0))).alias("ann_vol"),
        sharpe().alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.sum("turnover").alias("turnover"),
    )


@query("j04_index_intersection", "session_id", sql="SELECT session_id FROM fore WHERE pred IS NOT NULL AND var IS NOT NULL GROUP BY session_id HAVING count(DISTINCT model) = 4", tables=FORE)
def _intersection(spark, sf):
    from ..operators.align import in_all

    return in_all(forecasts(spark, sf).where("pred is not null and var is not null"), "model", "session_id", 4)


@query("m11_equal_weight", "session_id", "pred", sql="SELECT session_id, avg(pred) AS pred FROM fore GROUP BY session_id HAVING count(pred) = 4", tables=FORE, digits=9)
def _equal_weight(spark, sf):
    return forecasts(spark, sf).groupBy("session_id").agg(F.avg("pred").alias("pred"), F.count("pred").alias("n")).where("n = 4")


query("m10_mixture", "session_id", "mean std", sql="SELECT session_id, avg(pred) AS mean, sqrt(greatest(avg(var + pred * pred) - avg(pred) * avg(pred), 0)) AS std FROM fore GROUP BY session_id", tables=FORE, digits=8)(
    lambda s, d: forecasts(s, d).groupBy("session_id").agg(F.avg("pred").alias("mean"), F.sqrt(F.greatest(F.avg(F.col("var") + F.col("pred") ** 2) - F.avg("pred") ** 2, F.lit(0.0))).alias("std"))
)
query("m19_variance_proxy", "ticker session_id", "rv", sql="SELECT ticker, session_id, yo * yo + greatest(gk, 0) AS rv FROM ranges WHERE yo IS NOT NULL AND gk IS NOT NULL", tables=RANGES)(
    lambda s, d: proxy(M.grid(s, d)).where("rv is not null")
)
